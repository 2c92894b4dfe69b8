"""Approximate nearest neighbours by a hierarchical k-means tree searched best bin first."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, binary

#: Vectors the tree is fitted on at most, chosen by a hash of their id; every row is indexed.
SAMPLE = 20_000
FANOUT = 16
#: Sample vectors of a leaf, and rows of one block of a leaf.
LEAF = 64
BLOCK_ROWS = 4_096
#: Queries whose exact neighbours set the number of leaves to visit, and the recall they must reach.
CALIBRATION = 256
RECALL = 0.97


@dataclass
class Tree:
    """``centres`` of all nodes but the root; ``children`` lists nodes, ``leaf`` numbers leaves."""

    centres: np.ndarray
    children: list[list[int]]
    leaf: list[int]

    @property
    def leaves(self) -> int:
        return max(self.leaf) + 1

    def assign(self, unit: np.ndarray) -> np.ndarray:
        """The leaf of each row, descending to the nearest centre."""
        out = np.zeros(len(unit), np.int64)
        todo = [(0, np.arange(len(unit)))]
        while todo:
            node, rows = todo.pop()
            if self.leaf[node] >= 0:
                out[rows] = self.leaf[node]
                continue
            kids = self.children[node]
            nearest = np.argmax(unit[rows] @ self.centres[kids].T, axis=1)
            todo += [(kid, rows[nearest == k]) for k, kid in enumerate(kids) if (nearest == k).any()]
        return out

    def visit(self, unit: np.ndarray, most: int) -> list[int]:
        """The first ``most`` leaves for one query: open the best node of the queue, again and again."""
        queue, found = [(-1.0, 0)], []
        while queue and len(found) < most:
            _, node = heapq.heappop(queue)
            if self.leaf[node] >= 0:
                found.append(self.leaf[node])
                continue
            for kid, near in zip(self.children[node], self.centres[self.children[node]] @ unit, strict=True):
                heapq.heappush(queue, (-float(near), kid))
        return found


def grow(sample: np.ndarray, seed: int = 7) -> Tree:
    """Spherical k-means at every node until a node has at most ``LEAF`` sample vectors."""
    rng = np.random.default_rng(seed)
    centres, children, leaf = [np.zeros(sample.shape[1])], [[]], [-1]
    todo, leaves = [(0, sample)], 0
    while todo:
        node, rows = todo.pop()
        k = min(FANOUT, -(-len(rows) // LEAF))
        groups = _kmeans(rows, k, rng) if k > 1 else []
        if len(groups) < 2:
            leaf[node], leaves = leaves, leaves + 1
            continue
        for centre, own in groups:
            children[node].append(len(centres))
            centres.append(centre)
            children.append([])
            leaf.append(-1)
            todo.append((len(centres) - 1, own))
    return Tree(np.array(centres), children, leaf)


def _kmeans(rows: np.ndarray, k: int, rng, rounds: int = 8):
    distinct = np.unique(rows, axis=0)
    centres = distinct[rng.choice(len(distinct), min(k, len(distinct)), replace=False)]
    for _ in range(rounds):
        near = np.argmax(rows @ centres.T, axis=1)
        total = np.stack([np.bincount(near, rows[:, j], minlength=len(centres)) for j in range(rows.shape[1])], axis=1)
        norm = np.linalg.norm(total, axis=1)
        centres = np.where(norm[:, None] > 0, total / np.maximum(norm, 1e-300)[:, None], centres)
    near = np.argmax(rows @ centres.T, axis=1)
    return [(centres[j], rows[near == j]) for j in range(len(centres)) if (near == j).any()]


def _matrix(column: pa.Array) -> np.ndarray:
    return np.stack([np.frombuffer(x, "<f8") for x in column.to_pylist()]) if len(column) else np.zeros((0, 0))


def usable(embeddings: DataFrame) -> DataFrame:
    """``(vec_id, vector)``: finite nonzero vectors of the usual length as packed doubles."""
    v = F.transform(F.col("embedding"), lambda x: x.cast("double"))
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            rows = [np.asarray(x, "<f8").tobytes() for x in part["v"].to_pylist()]
            yield pa.RecordBatch.from_arrays([part["vec_id"], binary(rows)], ["vec_id", "vector"])

    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(
        F.col("vec_id").isNotNull() & F.col("v").isNotNull() & fine
    )
    lengths = rows.groupBy(F.size("v").alias("length")).count()
    usual = lengths.orderBy(F.col("count").desc(), "length").limit(1).collect()
    if usual:
        rows = rows.where(F.size("v") == usual[0]["length"])
    return rows.mapInArrow(packed, "vec_id bigint, vector binary")


def search(
    embeddings: DataFrame, is_query, k: int = 5, scratch: Scratch | None = None, recall: float = RECALL
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` nearest found of each query by cosine.

    The tree is fitted on a bounded sample and sent to all tasks; every row goes to its leaf. Equal
    vectors are one point of the index with a list of ids to come back, so a vector with a third of
    all rows is one point. Large leaves are cut into blocks. A query visits leaves best bin first;
    their number doubles until calibration queries, compared with all rows in blocks, reach
    ``recall``; the last resort is every leaf, which is exact.

    Vectors that are null, zero or hold null or non-finite components, and null ids, take no part.
    Vectors of another length than most (of the shorter, at a tie) take none either. Ties go to the smaller id. A repeated id counts once, with its
    smallest vector. Fewer candidates than ``k`` are all returned. An empty table gives no rows.
    """
    spark = embeddings.sparkSession
    scratch = scratch or Scratch(spark, "ann")
    vectors = scratch.settle(usable(embeddings).groupBy("vec_id").agg(F.min("vector").alias("vector")))
    # the k + 1 smallest ids of a point are all that its ties can give, the query itself among them
    points = scratch.settle(
        vectors.withColumn("r", F.row_number().over(Window.partitionBy("vector", F.pmod(F.xxhash64("vec_id"), F.lit(64))).orderBy("vec_id")))
        .where(F.col("r") <= k + 1)
        .groupBy("vector")
        .agg(F.slice(F.sort_array(F.collect_list("vec_id")), 1, k + 1).alias("ids"))
        .withColumn("point", F.element_at("ids", 1))
    )
    sample = [np.frombuffer(r[0], "<f8") for r in points.orderBy(F.xxhash64("point"), "point").limit(SAMPLE).select("vector").collect()]
    if not sample:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    sample = np.stack(sample)
    tree = grow(sample / np.linalg.norm(sample, axis=1, keepdims=True))
    shared = spark.sparkContext.broadcast(tree)

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            if part.num_rows:
                x = _matrix(part["vector"])
                leaf = shared.value.assign(x / np.linalg.norm(x, axis=1, keepdims=True))
                yield pa.RecordBatch.from_arrays([part["vector"], part["ids"], pa.array(leaf)], ["vector", "ids", "leaf"])

    index = scratch.settle(points.select("vector", "ids").mapInArrow(leaves, "vector binary, ids array<bigint>, leaf bigint"))
    blocks = scratch.settle(index.groupBy("leaf").agg(F.ceil(F.count("*") / BLOCK_ROWS).alias("blocks")))
    index = scratch.settle(
        index.join(blocks, "leaf").withColumn("block", F.pmod(F.xxhash64("vector"), F.col("blocks"))).drop("blocks")
    )
    queries = vectors.where(is_query)
    chosen = scratch.settle(queries.orderBy(F.xxhash64("vec_id", F.lit(3)), "vec_id").limit(CALIBRATION))
    exact = scratch.settle(_nearest(index, chosen, None, None, blocks, k))
    visits, everything = 4, tree.leaves
    while visits < everything:
        found = _nearest(index, chosen, shared, visits, blocks, k)
        hit = exact.join(found.select("query_id", "vec_id"), ["query_id", "vec_id"], "left_semi").count()
        if hit >= recall * exact.count():
            break
        visits *= 2
    return _nearest(index, queries, shared, min(visits, everything), blocks, k)


def _nearest(index: DataFrame, queries: DataFrame, shared, visits: int | None, blocks: DataFrame, k: int) -> DataFrame:
    """The nearest of each query in the leaves it visits, or in all blocks where ``shared`` is None."""

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            x = _matrix(part["vector"])
            leaf = [shared.value.visit(v / np.linalg.norm(v), visits) for v in x]
            yield pa.RecordBatch.from_arrays(
                [part["vec_id"], part["vector"], pa.array(leaf, pa.list_(pa.int64()))], ["vec_id", "vector", "leaves"]
            )

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {"query_id": [], "vec_id": [], "score": []}
        if left.num_rows and right.num_rows:
            x, names = _matrix(left["vector"]), left["ids"].to_pylist()
            sizes = np.linalg.norm(x, axis=1)
            for query_id, vector in zip(right["vec_id"].to_pylist(), right["vector"].to_pylist(), strict=True):
                q = np.frombuffer(vector, "<f8")
                score = (x @ q) / (sizes * np.linalg.norm(q))
                order = np.argsort(-score, kind="stable")
                # at a tie any point may hold the smaller id: take all points as near as the last
                edge = score[order[min(k, len(order) - 1)]]
                best = [(-score[j], i) for j in np.flatnonzero(score >= edge) for i in names[j] if i != query_id]
                for s, i in sorted(best)[:k]:
                    out["query_id"].append(query_id)
                    out["vec_id"].append(i)
                    out["score"].append(-s)
        return pa.table(out, schema=pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())]))

    if shared is None:
        routed = queries.select("vec_id", "vector").join(F.broadcast(blocks))
    else:
        routed = queries.mapInArrow(route, "vec_id bigint, vector binary, leaves array<bigint>")
        routed = routed.select("vec_id", "vector", F.explode("leaves").alias("leaf")).join(blocks, "leaf")
    routed = routed.select(
        "vec_id",
        "vector",
        F.col("leaf").alias("own_leaf"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("own_block"),
    )
    found = (
        index.groupBy("leaf", "block")
        .cogroup(routed.groupBy("own_leaf", "own_block"))
        .applyInArrow(compare, "query_id bigint, vec_id bigint, score double")
    )
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score"
    )
