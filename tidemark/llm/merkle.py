"""Merkle manifest of a table: 16-ary trees in van Emde Boas layout, proofs by address arithmetic."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, binary

#: Children of a node as a power of two, and edges between the root and the leaves of a stored block at most.
SHIFT = 4
FANOUT = 1 << SHIFT
EDGES = 3
#: Tree number of the tree over all subroots.
TOP = -1
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_HEX = 64


# --- layout ---------------------------------------------------------------------------------


def nodes_in(levels: int) -> int:
    return ((1 << SHIFT * levels) - 1) // (FANOUT - 1)


def address(levels: int, depth: int, index: np.ndarray) -> np.ndarray:
    """Place of node ``index`` at ``depth`` in a tree of ``levels``: the upper half of the levels first,
    then the subtrees below it from left to right, each laid out alike."""
    if levels == 1:
        return np.zeros_like(index)
    top = levels // 2
    if depth < top:
        return address(top, depth, index)
    below = SHIFT * (depth - top)
    subtree = index >> below
    return nodes_in(top) + subtree * nodes_in(levels - top) + address(levels - top, depth - top, index - (subtree << below))


def cuts(height: int) -> list[int]:
    """Heights of the blocks between leaves and root, lowest first: halves of halves, until one fits a block."""
    if height <= EDGES:
        return [height]
    bottom = (height + 1) // 2
    return cuts(bottom) + cuts(height - bottom)


def heights(size: Column) -> Column:
    """``cuts`` of the tree over ``size`` leaves, which ends at the first level with one node."""
    found = F.when(size <= 1, F.array(F.lit(0)))
    for height in range(1, 16):
        found = found.when(size <= 1 << SHIFT * height, F.array(*map(F.lit, cuts(height))))
    return found


def _level(store: np.ndarray, height: int, depth: int, count: int) -> str:
    """Digests of one level from left to right, as hex text."""
    return store[address(height + 1, depth, np.arange(count))].tobytes().hex()


def _widths(leaves: int, height: int) -> list[int]:
    """Nodes of each level, the root's first."""
    return [-(-leaves >> SHIFT * (height - depth)) for depth in range(height + 1)]


def block(digests: list[bytes], height: int) -> np.ndarray:
    """One subtree over its leaves in order: rows of 32 bytes by address, as far as nodes are there."""
    widths = _widths(len(digests), height)
    last = [int(address(height + 1, d, np.array([w - 1]))[0]) for d, w in enumerate(widths)]
    store = np.zeros((max(last) + 1, 32), np.uint8)
    store[address(height + 1, height, np.arange(len(digests)))] = np.frombuffer(b"".join(digests), np.uint8).reshape(-1, 32)
    for depth in range(height, 0, -1):
        text = _level(store, height, depth, widths[depth]).encode()
        run = FANOUT * _HEX
        up = b"".join(sha256(text[k : k + run]).digest() for k in range(0, len(text), run))
        store[address(height + 1, depth - 1, np.arange(widths[depth - 1]))] = np.frombuffer(up, np.uint8).reshape(-1, 32)
    return store


class Siblings:
    """Sibling digests on the way from a leaf of a stored block to the block's root."""

    def __init__(self, nodes: bytes, height: int, leaves: int):
        store = np.frombuffer(nodes, np.uint8).reshape(-1, 32)
        self.height = height
        self.levels = [_level(store, height, d, w) for d, w in enumerate(_widths(leaves, height))]

    def of(self, leaf: int) -> list[tuple[str, str]]:
        """What stands left and right of the path, lowest level first."""
        found = []
        for depth in range(self.height, 0, -1):
            at = leaf >> SHIFT * (self.height - depth)
            run = at >> SHIFT << SHIFT
            text = self.levels[depth]
            found.append((text[run * _HEX : at * _HEX], text[(at + 1) * _HEX : (run + FANOUT) * _HEX]))
        return found


def proof_digest(path: list[tuple[str, str]]) -> str:
    return sha256("".join(left + right for left, right in path).encode()).hexdigest()


def folded(leaf: str, path: list[tuple[str, str]]) -> str:
    """The root that a leaf and its siblings give."""
    for left, right in path:
        leaf = sha256((left + leaf + right).encode()).hexdigest()
    return leaf


# --- leaves and their places ----------------------------------------------------------------


def leaf_digest(columns: dict[str, Column] | None = None) -> Column:
    """SHA-256 of all fields, each ``-`` or its byte count, ``:`` and itself; as 32 bytes."""
    parts = []
    for name in FIELDS:
        value = (columns or {}).get(name, F.col(name)).cast("string")
        parts.append(F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value)))
    return F.unhex(F.sha2(F.concat(*parts), 256))


def numbered(df: DataFrame, keys: list[str], scratch: Scratch) -> DataFrame:
    """``df`` with its rank ``at`` in the order of ``keys`` and the range ``part`` it was sorted in.

    Ranges are sorted by a task each; only their row counts meet, one row for each range.
    """
    low = (1 << 33) - 1
    ranged = scratch.settle(
        df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__id", F.monotonically_increasing_id())
    ).withColumn("part", F.shiftright("__id", 33))
    counts = ranged.groupBy("part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    first = counts.select("part", F.coalesce(before, F.lit(0)).alias("first"))
    return ranged.join(F.broadcast(first), "part").withColumn("at", F.col("first") + F.col("__id").bitwiseAND(low)).drop("__id", "first")


def placed(leaves: DataFrame, scratch: Scratch) -> DataFrame:
    """Leaves with ``tree``, the rank of their source, ``pos`` in it and the ``heights`` of its blocks.

    A source's start and size come from its few sorted ranges and return by range and source, so
    that a source with a third of all rows meets in no task.
    """
    rows = numbered(leaves, ["source", "doc_id", "leaf"], scratch)
    runs = scratch.settle(rows.groupBy("part", "source").agg(F.min("at").alias("first"), F.count("*").alias("n")))
    sources = runs.groupBy("source").agg(F.min("first").alias("start"), F.sum("n").alias("size"))
    trees = numbered(sources, ["source"], scratch).select(
        F.col("source").alias("own"), F.col("at").alias("tree"), "start", heights(F.col("size")).alias("heights")
    )
    known = runs.join(trees, F.col("source").eqNullSafe(F.col("own"))).select(F.col("part").alias("own_part"), "own", "tree", "start", "heights")
    here = (F.col("part") == F.col("own_part")) & F.col("source").eqNullSafe(F.col("own"))
    return rows.join(known, here).withColumn("pos", F.col("at") - F.col("start")).drop("part", "at", "source", "own", "own_part", "start")


# --- trees ----------------------------------------------------------------------------------

BLOCKS = "tree bigint, block bigint, heights array<int>, leaves int, nodes binary, root binary"


def _cell(tier: int) -> list[Column]:
    bits = f"{SHIFT} * heights[{tier}]"
    return [F.expr(f"shiftright(pos, {bits})").alias("block"), F.expr(f"cast(pos & (shiftleft(1L, {bits}) - 1) as int)").alias("slot")]


def _build(tier: int):
    """The stored block over the leaves of one group."""

    def run(rows: pa.Table) -> pa.Table:
        order = np.argsort(np.asarray(rows["slot"]))
        digests, own = rows["digest"].to_pylist(), rows["heights"][0].as_py()
        store = block([digests[k] for k in order], own[tier])
        row = {"tree": rows["tree"][0].as_py(), "block": rows["block"][0].as_py(), "heights": own, "leaves": len(digests)}
        row |= {"nodes": store.tobytes(), "root": store[0].tobytes()}
        kinds = [pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.int32(), pa.binary(), pa.binary()]
        return pa.Table.from_pylist([row], pa.schema(list(zip(row, kinds, strict=True))))

    return run


def climb(leaves: DataFrame, scratch: Scratch) -> list[DataFrame]:
    """Stored blocks of all trees over ``(tree, pos, heights, digest)``, a table for each tier, lowest first.

    A block takes at most 16**3 leaves, its height full but at the top of a tree. The roots of one
    tier are the leaves of the next.
    """
    tiers = leaves.agg(F.max(F.size("heights"))).first()[0] or 0
    frames = []
    for tier in range(tiers):
        cells = leaves.select("tree", "heights", "digest", *_cell(tier))
        frames.append(scratch.settle(cells.groupBy("tree", "block").applyInArrow(_build(tier), BLOCKS)))
        leaves = frames[-1].where(F.size("heights") > tier + 1).select(
            "tree", F.col("block").alias("pos"), "heights", F.col("root").alias("digest")
        )
    return frames


def roots(frames: list[DataFrame]) -> DataFrame:
    """``(tree, root)``: the block at the top of each tree."""
    tops = [f.where(F.size("heights") == tier + 1).select("tree", "root") for tier, f in enumerate(frames)]
    out = tops[0]
    for more in tops[1:]:
        out = out.unionByName(more)
    return out


ABOVE = "array<struct<left:string,right:string>>"
STEPS = f"tree bigint, child bigint, digest binary, above {ABOVE}, subroot binary, root binary"
_PATH = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))


def _path(above: list[dict]) -> list[tuple[str, str]]:
    return [(x["left"], x["right"]) for x in above]


def _expand(tier: int):
    """Each leaf of a block with all siblings above it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                height = row["heights"][tier]
                siblings = Siblings(row["nodes"], height, row["leaves"])
                rest, n = _path(row["above"]), row["leaves"]
                paths = [[{"left": a, "right": b} for a, b in siblings.of(k) + rest] for k in range(n)]
                own = [bytes.fromhex(siblings.levels[-1][k * _HEX : (k + 1) * _HEX]) for k in range(n)]
                child = (row["block"] << SHIFT * height) + np.arange(n)
                columns = [pa.array([row["tree"]] * n), pa.array(child), binary(own), pa.array(paths, _PATH)]
                columns += [binary([row[c]] * n) for c in ("subroot", "root")]
                yield pa.RecordBatch.from_arrays(columns, ["tree", "child", "digest", "above", "subroot", "root"])

    return run


def descend(frames: list[DataFrame], start: DataFrame, scratch: Scratch) -> DataFrame:
    """The lowest blocks with the siblings above them; ``start`` has ``(tree, above, subroot, root)`` of each tree's root."""
    carried = None
    for tier in reversed(range(len(frames))):
        rows = frames[tier].drop("root")
        known = rows.where(F.size("heights") == tier + 1).join(start, "tree")
        if carried is not None:
            known = known.unionByName(rows.where(F.size("heights") > tier + 1).join(carried, ["tree", "block"]))
        if tier:
            wide = known.mapInArrow(_expand(tier), STEPS)
            carried = scratch.settle(wide.select("tree", F.col("child").alias("block"), "above", "subroot", "root"))
    return known


@dataclass
class Manifest:
    """Leaves in their places and the stored blocks of source trees and of the tree over them."""

    leaves: DataFrame
    sources: list[DataFrame]
    top: list[DataFrame]
    scratch: Scratch

    def root(self) -> str | None:
        """Hex digest of the whole table, None for an empty one."""
        row = roots(self.top).first() if self.top else None
        return None if row is None else row["root"].hex()


def manifest(docs: DataFrame, claimed: Column | None = None, scratch: Scratch | None = None) -> Manifest:
    """Trees over ``docs``: one for each source, leaves by ascending ``doc_id``, and one over their roots.

    ``claimed`` is the text to be checked later, that of the row itself where it is None.
    Rows with null ids come first in their source, the null source first of all. Rows with one id
    are ordered by digest, so that equal rows are leaves side by side. Null fields differ from empty
    ones. Texts of any length are hashed whole and leave the reading task as digests. Columns beyond
    the five fields are ignored. An empty table has no leaf and no root.
    """
    scratch = scratch or Scratch(docs.sparkSession, "merkle")
    own = leaf_digest()
    other = own if claimed is None else leaf_digest({"text": claimed})
    # only the digests travel
    leaves = scratch.settle(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), own.alias("leaf"), other.alias("claimed")))
    rows = scratch.settle(placed(leaves, scratch))
    sources = climb(rows.withColumnRenamed("leaf", "digest"), scratch)
    if not sources:
        return Manifest(rows, [], [], scratch)
    subroots = roots(sources)
    size = heights(F.lit(subroots.count()))
    top = climb(subroots.select(F.lit(TOP).cast("long").alias("tree"), F.col("tree").alias("pos"), size.alias("heights"), F.col("root").alias("digest")), scratch)
    return Manifest(rows, sources, top, scratch)


PROOFS = "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def proofs(made: Manifest) -> DataFrame:
    """Each leaf with the digest of its proof, and whether its claimed text leads to the root.

    A lowest block and what stands above it meet its leaves, 16**3 at most, in one group.
    """
    spark, scratch = made.leaves.sparkSession, made.scratch
    if not made.top:
        return spark.createDataFrame([], PROOFS)
    none = F.array().cast(ABOVE)
    whole = roots(made.top).select("tree", none.alias("above"), F.lit(None).cast("binary").alias("subroot"), "root")
    tops = descend(made.top, whole, scratch).mapInArrow(_expand(0), STEPS)
    start = scratch.settle(tops.select(F.col("child").alias("tree"), "above", F.col("digest").alias("subroot"), "root"))
    blocks = descend(made.sources, start, scratch).withColumnRenamed("tree", "own_tree").withColumnRenamed("block", "own_block")

    def prove(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {f.name: [] for f in schema}
        above = right.to_pylist()[0]
        siblings, rest = Siblings(above["nodes"], above["heights"][0], above["leaves"]), _path(above["above"])
        subroot, root = above["subroot"].hex(), above["root"].hex()
        for doc_id, slot, leaf, claimed in zip(*(left[c].to_pylist() for c in ("doc_id", "slot", "leaf", "claimed")), strict=True):
            path = siblings.of(slot) + rest
            found = folded(claimed.hex(), path)
            row = (doc_id, leaf.hex(), subroot, root, proof_digest(path), found, found == root)
            for name, value in zip(out, row, strict=True):
                out[name].append(value)
        return pa.table(out, schema)

    schema = pa.schema(
        [("doc_id", pa.int64()), *((c, pa.string()) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")), ("verified", pa.bool_())]
    )
    members = made.leaves.select("doc_id", "leaf", "claimed", "tree", *_cell(0))
    return members.groupBy("tree", "block").cogroup(blocks.groupBy("own_tree", "own_block")).applyInArrow(prove, PROOFS)


def lowered_in_fold(modulus: int = 5) -> Column:
    """The text with A-Z lowered where ``modulus`` divides the CRC-32 of the id: a stand-in for tampering."""
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == 0
    return F.when(hit, F.translate("text", UPPER, LOWER)).otherwise(F.col("text"))
