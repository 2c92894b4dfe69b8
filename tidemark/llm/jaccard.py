"""Set similarity join on word shingles by grouped prefixes, exact for its threshold."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, binary, cell_counts, cells_used, grams, joined, mapper, mix, texts, words
from tidemark.llm.components import band, components, cross_pairs, ordered, star_pairs

#: Least and most bits of the sketch that orders shingles: common ones come last. Any order is
#: right. It has a cell for ``CELL_BYTES`` bytes of text, so that lists keep their length as the
#: corpus grows, until it has as much as a task may hold (64 MB).
ORDER_BITS = (16, 24)
CELL_BYTES = 256
#: Bits of a shingle's order below the level that says how common it is.
LEVEL_SHIFT = 57
#: Longs of a prefix's bit marks, and of the bit marks of a whole set.
MARKS = 2
SKETCH = 8
#: Cells of the filter that picks documents whose sets are needed. A join drops what it lets through.
PICK_BITS = 22


def shingle_sets(column: pa.Array, size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; with fewer words, one for the whole sequence."""
    buffer, starts = joined(column, lower=True)
    hashes, at, _ = words(buffer)
    cuts = np.searchsorted(at, starts)
    all_grams = grams(hashes, size)
    out = []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if b - a >= size:
            out.append(np.unique(all_grams[a : b - size + 1]))
        elif b > a:
            out.append(grams(hashes[a:b], int(b - a), seed=1 << 20))
        else:
            out.append(hashes[:0])
    return out


def least_overlap(a, b, percent: int):
    """The smallest overlap of sets of these sizes that reaches the similarity."""
    return F.ceil(F.lit(percent) * (a + b) / F.lit(100.0 + percent) - F.lit(1e-9))


def similar_documents(
    docs: DataFrame, size: int = 5, percent: int = 80, scratch: Scratch | None = None
) -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` of each row; links hold at Jaccard >= ``percent`` / 100.

    1. Documents with one and the same set form a class, and are represented by its smallest id.
    2. Two linked sets share a shingle among the first ``n - ceil(percent * n) + 1`` in any fixed
       order. Classes with equal size and prefix form a group; groups meet by prefix shingle.
    3. Round one links each class to one hub of its group, and each group to a hub among groups of
       like size that share a prefix shingle. Round two takes, for every shingle, all pairs that
       are still in different components. So a family of near copies costs a star and not all its
       pairs, and no link between components is lost. A shingle is left out only where no pair
       needs it: one group alone has it, and its classes meet by the first of their prefix, if
       there are several.
    4. A pair is verified on whole sets when the exact bound from its two prefixes allows it.

    Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z. Null, empty and wordless texts have no
    shingles and link with nothing. Rows with a null ``doc_id`` come back with a null component.
    Repeated rows come back as often. Texts of any length count whole. An empty table gives no rows.
    Further columns are ignored.
    """
    scratch = scratch or Scratch(docs.sparkSession, "jaccard")
    rows = texts(docs)
    sets = scratch.settle(_prefixes(rows, size, percent))
    listed = scratch.settle(sets.select("doc_id", "n", "set_key"))
    classes = scratch.settle(
        sets.where("n > 0 and doc_id is not null")
        .groupBy("set_key", "n")
        .agg(F.min("doc_id").alias("cid"), *(F.first(c).alias(c) for c in ("prefix", "marks", "sketch")))
    )
    scratch.discard(sets)
    # a document listed with several texts is one node: its classes are told apart by set_key
    members = scratch.settle(
        classes.join(
            classes.groupBy("n", "prefix").agg(F.min("cid").alias("gid"), F.count("*").alias("size")), ["n", "prefix"]
        )
    )
    scratch.discard(classes)
    # one id may head several groups of one size: each of its prefixes is posted
    heads = members.where("cid = gid").select("gid", "n", "prefix", "size").distinct()
    # the base of a family has its common shingles, a copy of its own has rare ones in their place;
    # how common a shingle is stands in the highest bits of its order
    strength = F.aggregate("prefix", F.lit(0).cast("long"), lambda s, x: s + F.shiftright(x, LEVEL_SHIFT))
    posted = heads.select(
        "gid", "n", F.posexplode("prefix").alias("at", "token"), "size",
        band(F.col("n"), percent).alias("band"), strength.cast("int").alias("strength"),
    )
    # classes of one group meet by the first shingle of their prefix, also where no other group has it
    weight = F.when(F.col("at") == 0, F.col("size")).otherwise(1)
    posted = posted.select("gid", "n", "at", "token", "band", "strength", weight.alias("weight"))
    shared = posted.groupBy("token").agg(F.sum("weight").alias("c")).where("c > 1").select("token")
    posted = scratch.settle(posted.drop("weight").join(shared, "token"))
    strong = posted.select("token", "band", F.col("gid").alias("node"), F.col("strength").cast("long").alias("strength"))

    inside = members.where("size > 1").select(F.col("gid").alias("a"), F.col("cid").alias("b"))
    tried = scratch.settle(ordered(star_pairs(strong).union(inside)))
    links = _verified(_bounded(tried, members, percent, scratch), rows, size, percent, scratch)
    found = scratch.settle(components(links, scratch))
    detail = members.select(
        F.col("cid").alias("node"), "n", "marks", "sketch", F.size("prefix").alias("p"), F.element_at("prefix", -1).alias("last")
    )
    nodes = posted.join(members.select("gid", "n", F.col("cid").alias("node")).distinct(), ["gid", "n"]).select("token", "band", "node", "at")
    more = cross_pairs(
        nodes, detail.distinct(), found, tried, percent, lambda a, b: _placed(a, b, percent) & _room(a, b, percent), scratch
    )
    more = _bounded(scratch.settle(more), members, percent, scratch)
    if not more.isEmpty():
        links = links.union(_verified(more, rows, size, percent, scratch))
        found = scratch.settle(components(links, scratch))
    named = members.join(found.withColumnRenamed("node", "cid"), "cid", "left").select(
        "set_key", "n", F.coalesce("component", "cid").alias("component")
    )
    out = listed.join(named, ["set_key", "n"], "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"),
    )
    out = scratch.settle(out)
    for done in (listed, members, posted, tried, links, found):
        scratch.discard(done)
    return out


def _prefixes(rows: DataFrame, size: int, percent: int) -> DataFrame:
    spark = rows.sparkSession
    volume = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(max((volume // CELL_BYTES).bit_length(), ORDER_BITS[0]), ORDER_BITS[1])
    shift = np.uint64(64 - bits)

    def cells(part: pa.RecordBatch) -> np.ndarray:
        found = shingle_sets(part["text"], size)
        return (mix(np.concatenate(found)) >> shift).astype(np.int64)

    counts = cell_counts(rows, cells, ["text"], bits)
    usual = max(1.0, 2 * counts.mean())
    levels = spark.sparkContext.broadcast(np.maximum(0, np.ceil(np.log2(np.maximum(counts / usual, 1)))).astype(np.uint64))

    def prefixes(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ns, keys, heads, marks, sketches = [], [], [], [], []
        for found in shingle_sets(part["text"], size):
            n = len(found)
            ns.append(n)
            keys.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
            if n:
                mixed = mix(found)
                order = levels.value[(mixed >> shift).astype(np.int64)] << np.uint64(LEVEL_SHIFT) | mixed >> np.uint64(64 - LEVEL_SHIFT)
                p = n - -(-percent * n // 100) + 1
                heads.append(np.sort(np.partition(order, p - 1)[:p] if p < n else order).astype(np.int64))
            else:
                heads.append(np.zeros(0, np.int64))
            bit = np.left_shift(np.int64(1), heads[-1] >> 2 & 63)
            marks.append([int(np.bitwise_or.reduce(bit[heads[-1] & (MARKS - 1) == k])) for k in range(MARKS)])
            spots = np.zeros(64 * SKETCH, np.uint8)
            spots[(found >> np.uint64(20) & np.uint64(64 * SKETCH - 1)).astype(np.int64)] = 1
            sketches.append(np.packbits(spots).view("<i8"))
        many = pa.list_(pa.int64())
        yield pa.RecordBatch.from_arrays(
            [part["doc_id"], pa.array(ns, pa.int64()), binary(keys), *(pa.array(x, many) for x in (heads, marks, sketches))],
            ["doc_id", "n", "set_key", "prefix", "marks", "sketch"],
        )

    schema = "doc_id bigint, n bigint, set_key binary, prefix array<bigint>, marks array<bigint>, sketch array<bigint>"
    return rows.mapInArrow(mapper(prefixes), schema)


def _room(a, b, percent: int):
    """Whether two sets may overlap enough, by the marks of their prefixes and of the whole sets.

    A mark of one side that the other lacks stands for a shingle, at least, that is not common.
    """

    def lost(x, y, name, longs):
        return sum(F.bit_count(x(name)[k].bitwiseAND(F.bitwise_not(y(name)[k]))) for k in range(longs))

    need = least_overlap(a("n"), b("n"), percent)
    common = F.least(a("p") - lost(a, b, "marks", MARKS), b("p") - lost(b, a, "marks", MARKS))
    rest = F.when(a("last") <= b("last"), a("n") - a("p")).otherwise(b("n") - b("p"))
    whole = F.least(a("n") - lost(a, b, "sketch", SKETCH), b("n") - lost(b, a, "sketch", SKETCH))
    return (common + rest >= need) & (whole >= need)


def _placed(a, b, percent: int):
    """Whether two sets may overlap enough if the shingle they meet by is their first common one.

    What stands before it is then in one set alone. Every pair has a first common shingle, so none that
    links is lost, and the places a pair meets at grow fewer.
    """
    return F.least(a("n") - a("at"), b("n") - b("at")) >= least_overlap(a("n"), b("n"), percent)


def _sides(pairs: DataFrame, side: DataFrame) -> DataFrame:
    left = side.select(*(F.col(c).alias(f"{c}_a") for c in side.columns)).withColumnRenamed("cid_a", "a")
    right = side.select(*(F.col(c).alias(f"{c}_b") for c in side.columns)).withColumnRenamed("cid_b", "b")
    return pairs.join(left, "a").join(right, "b")


def _bounded(pairs: DataFrame, members: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Pairs whose prefixes leave room for the overlap; marks decide first, so that few prefixes travel.

    Let one prefix end no later than the other. A common shingle up to that end is in both; beyond
    it there are at most as many as that set has left.
    """
    narrow = members.select("cid", "n", "set_key", "marks", "sketch", F.size("prefix").alias("p"), F.element_at("prefix", -1).alias("last"))
    both = _sides(pairs, narrow)
    room = _room(lambda c: F.col(f"{c}_a"), lambda c: F.col(f"{c}_b"), percent)
    likely = scratch.settle(both.where(room).select("a", "b", "set_key_a", "set_key_b", "n_a", "n_b"))
    left = members.select(F.col("cid").alias("a"), F.col("set_key").alias("set_key_a"), F.col("prefix").alias("prefix_a"))
    right = members.select(F.col("cid").alias("b"), F.col("set_key").alias("set_key_b"), F.col("prefix").alias("prefix_b"))
    both = likely.join(left, ["a", "set_key_a"]).join(right, ["b", "set_key_b"])
    common = F.size(F.array_intersect("prefix_a", "prefix_b"))
    rest = F.when(
        F.element_at("prefix_a", -1) <= F.element_at("prefix_b", -1), F.col("n_a") - F.size("prefix_a")
    ).otherwise(F.col("n_b") - F.size("prefix_b"))
    need = least_overlap(F.col("n_a"), F.col("n_b"), percent)
    room = (F.least("n_a", "n_b") >= need) & (common > 0) & (common + rest >= need)
    out = scratch.settle(both.where(room).select("a", "b", "set_key_a", "set_key_b"))
    scratch.discard(likely)
    return out


def _verified(pairs: DataFrame, rows: DataFrame, size: int, percent: int, scratch: Scratch) -> DataFrame:
    """``(a, b)`` of the settled pairs that link, decided on whole sets."""
    needed = scratch.settle(
        pairs.select(F.col("a").alias("doc_id"), F.col("set_key_a").alias("set_key"))
        .union(pairs.select("b", "set_key_b"))
        .distinct()
    )
    shift = np.uint64(64 - PICK_BITS)

    def cells_of(ids: pa.Array) -> np.ndarray:
        known = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.uint64)
        return (mix(known + np.uint64(0x1234567)) >> shift).astype(np.int64)

    used = cells_used(needed, lambda part: cells_of(part["doc_id"]), ["doc_id"], PICK_BITS)
    picked = rows.sparkSession.sparkContext.broadcast(used)

    def whole(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        at = cells_of(part["doc_id"])
        chosen = picked.value[at >> 3] >> (7 - (at & 7)) & 1
        part = part.filter(pa.array(chosen.astype(bool)))
        if part.num_rows:
            found = [x.tobytes() for x in shingle_sets(part["text"], size)]
            keys = [hashlib.blake2b(x, digest_size=16).digest() for x in found]
            yield pa.RecordBatch.from_arrays([part["doc_id"], binary(keys), binary(found)], ["doc_id", "set_key", "body"])

    bodies = rows.mapInArrow(mapper(whole), "doc_id bigint, set_key binary, body binary")
    bodies = scratch.settle(bodies.join(needed, ["doc_id", "set_key"], "left_semi"))
    left = bodies.select(F.col("doc_id").alias("a"), F.col("set_key").alias("set_key_a"), F.col("body").alias("body_a"))
    right = bodies.select(F.col("doc_id").alias("b"), F.col("set_key").alias("set_key_b"), F.col("body").alias("body_b"))
    both = pairs.join(left, ["a", "set_key_a"]).join(right, ["b", "set_key_b"]).select("a", "b", "body_a", "body_b")

    def linked(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        keep = []
        for x, y in zip(part["body_a"].to_pylist(), part["body_b"].to_pylist(), strict=True):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            same = len(x) + len(y) - len(np.union1d(x, y))
            keep.append(100 * same >= percent * (len(x) + len(y) - same))
        yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    out = scratch.settle(both.mapInArrow(mapper(linked, "body_a"), "a bigint, b bigint").distinct())
    for done in (pairs, needed, bodies):
        scratch.discard(done)
    return out
