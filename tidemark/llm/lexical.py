"""Ranked lexical search: impact vectors in norm buckets, bounds before exact integer scores."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, mapper

#: (item, term) pairs that are searched for at once, and documents of a norm bucket.
ENTRIES = 1 << 18
BUCKET = 2_048
#: Heaviest terms of an item that are looked at before the rest is bounded.
FOCUS = 6
#: Room for rounding in the bounds, which are doubles; scores are integers.
SLACK = 1e-9

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Terms are runs of what is no ASCII sign: bytes beyond ASCII, digits and letters, A-Z lowered.
PATTERN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_TERM = bytes(c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256)).lower()
#: Stands for a null id, which sorts first.
_NULL = -(1 << 63)


def terms(text: bytes) -> list[bytes]:
    return text.translate(_TERM).split()


def _bytes(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def item_terms(items: DataFrame) -> DataFrame:
    """``(item_id, term)``, each once; rows with one id are one item with all their terms."""

    def split(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        found = [sorted(set(terms(x))) for x in _bytes(part["text"])]
        ids = [i for i, own in zip(part["item_id"].to_pylist(), found, strict=True) for _ in own]
        flat = [t for own in found for t in own]
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(flat, pa.binary())], ["item_id", "term"])

    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(mapper(split), "item_id bigint, term binary").distinct()


def counted(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """``(doc_id, n, terms, tfs)``: all terms counted, those of the vocabulary by number."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    kind = pa.list_(pa.int32())

    def count(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        number, lengths, own, often = shared.value.get, [], [], []
        for text in _bytes(part["text"]):
            found = terms(text)
            tally = Counter(map(number, found))
            tally.pop(None, None)
            lengths.append(len(found))
            own.append(list(tally))
            often.append(list(tally.values()))
        yield pa.RecordBatch.from_arrays(
            [part["doc_id"], pa.array(lengths, pa.int64()), pa.array(own, kind), pa.array(often, kind)], ["doc_id", "n", "terms", "tfs"]
        )

    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL)).alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(mapper(count), "doc_id bigint, n bigint, terms array<int>, tfs array<int>")


@dataclass
class Queries:
    """Items as sparse vectors: ``items[k]`` has the terms ``term[start[k]:start[k + 1]]``, heaviest first."""

    items: list[int | None]
    start: np.ndarray
    term: np.ndarray
    weight: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    def weighted(self, weight: np.ndarray) -> Queries:
        """With term weights known, terms in their order and those that weigh nothing gone."""
        start, kept = [0], []
        for k in range(len(self.items)):
            own = self.term[self.start[k] : self.start[k + 1]]
            own = own[weight[own] > 0]
            kept.append(own[np.argsort(-weight[own], kind="stable")])
            start.append(start[-1] + len(own))
        return Queries(self.items, np.array(start), np.concatenate([*kept, np.zeros(0, np.int64)]).astype(np.int64), weight)

    def terms_of(self, k: int) -> np.ndarray:
        return self.term[self.start[k] : self.start[k + 1]]


def impacts(vectors: DataFrame, weight: np.ndarray, documents: int, occurrences: int) -> DataFrame:
    """``(doc_id, terms, impacts, norm)``: what a term adds to a score, but for its weight.

    Document and item share a term's weight by its square root, so that a score is the product of
    both vectors and the norm is that of the document's.
    """
    root = vectors.sparkSession.sparkContext.broadcast(np.sqrt(weight.astype(float)))
    kind = pa.list_(pa.int32())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            own, often = part["terms"], part["tfs"]
            at = np.asarray(own.offsets, np.int64)
            term = np.asarray(own.values, np.int64)[at[0] : at[-1]]
            tf = np.asarray(often.values, np.int64)[often.offsets[0].as_py() : often.offsets[-1].as_py()]
            sizes = np.diff(at)
            row = np.repeat(np.arange(part.num_rows), sizes)
            m = 10 + (90 * np.asarray(part["n"], np.int64) * documents) // occurrences
            value = (1_000_000_000 * tf) // (1000 * tf + 8 * m[row])
            norm = np.sqrt(np.bincount(row, (root.value[term] * value) ** 2, minlength=part.num_rows))
            cells = pa.ListArray.from_arrays(pa.array(at - at[0], pa.int32()), pa.array(value, pa.int32()))
            yield pa.RecordBatch.from_arrays([part["doc_id"], own.cast(kind), cells, pa.array(norm)], ["doc_id", "terms", "impacts", "norm"])

    return vectors.where(F.size("terms") > 0).mapInArrow(run, "doc_id bigint, terms array<int>, impacts array<int>, norm double").where("norm > 0")


class Bucket:
    """Documents of similar norm, by document and by term."""

    def __init__(self, part: pa.RecordBatch, root: np.ndarray):
        self.ids = np.asarray(part["doc_id"], np.int64)
        self.norm = np.asarray(part["norm"], float)
        own, values = part["terms"], part["impacts"]
        at = np.asarray(own.offsets, np.int64)
        self.at = at - at[0]
        self.term = np.asarray(own.values, np.int64)[at[0] : at[-1]]
        self.impact = np.asarray(values.values, np.int64)[values.offsets[0].as_py() : values.offsets[-1].as_py()]
        order = np.argsort(self.term, kind="stable")
        self.doc = np.repeat(np.arange(len(self.ids)), np.diff(self.at))[order]
        self.value = (root[self.term] * self.impact)[order]
        self.first = np.searchsorted(self.term[order], np.arange(len(root) + 1))

    def survivors(self, query: np.ndarray, root: np.ndarray, least: float) -> np.ndarray:
        """Documents whose heaviest coordinates leave room for a score of ``least``.

        What the focus coordinates give is known; the rest is at most the product of the norms that
        are left of document and item.
        """
        gained, used = np.zeros(len(self.ids)), np.zeros(len(self.ids))
        for t in query[:FOCUS]:
            here = slice(self.first[t], self.first[t + 1])
            gained[self.doc[here]] += root[t] * self.value[here]
            used[self.doc[here]] += self.value[here] ** 2
        left = math.sqrt(float(np.sum(root[query[FOCUS:]] ** 2)))
        # what is left of a norm is a difference: room is given in parts of the whole norm
        bound = gained + left * np.sqrt(np.maximum(self.norm**2 * (1 + SLACK) - used, 0))
        return np.flatnonzero((bound * (1 + SLACK) >= least) & (bound > 0))

    def scores(self, docs: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Exact scores; ``weights`` has those of one item by term, 0 elsewhere."""
        sizes = self.at[docs + 1] - self.at[docs]
        ends = np.cumsum(sizes)
        cells = np.arange(ends[-1]) + np.repeat(self.at[docs] - (ends - sizes), sizes)
        return np.add.reduceat(weights[self.term[cells]] * self.impact[cells], ends - sizes)


def _search(queries: Queries, least: np.ndarray, k: int):
    """Best documents of each item in one range of norms, the largest norms first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root = np.sqrt(queries.weight.astype(float))
        lengths = np.array([math.sqrt(float(np.sum(root[queries.terms_of(q)] ** 2))) for q in range(len(queries.items))])
        floor = least.copy()
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in queries.items]
        weights = np.zeros(len(root), np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, BUCKET):
                part = batch.slice(at, BUCKET)
                longest = float(np.max(np.asarray(part["norm"], float)))
                open_ = np.flatnonzero((lengths * longest * (1 + SLACK) >= floor) & (lengths > 0))
                if not len(open_):
                    continue
                bucket = Bucket(part, root)
                for q in open_:
                    own = queries.terms_of(q)
                    docs = bucket.survivors(own, root, float(floor[q]))
                    if not len(docs):
                        continue
                    weights[own] = queries.weight[own]
                    score = bucket.scores(docs, weights)
                    weights[own] = 0
                    good = (score > 0) & (score >= floor[q])
                    if good.any():
                        scores, ids = np.append(best[q][0], score[good]), np.append(best[q][1], bucket.ids[docs[good]])
                        order = np.lexsort((ids, -scores))[:k]
                        best[q] = scores[order], ids[order]
                        if len(order) == k:
                            floor[q] = max(floor[q], scores[order[-1]])
        sizes = [len(s) for s, _ in best]
        columns = [np.repeat(np.arange(len(best)), sizes), *(np.concatenate([b[c] for b in best]) for c in (1, 0))]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["query", "doc_id", "score"])

    return run


def _top(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), "doc_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


RESULT = "item_id bigint, rank int, doc_id bigint, score bigint"
_FOUND = "query bigint, doc_id bigint, score bigint"


def search(docs: DataFrame, items: DataFrame, k: int = 10, scratch: Scratch | None = None) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the ``k`` highest-scoring documents of each item, exactly.

    Items are taken in blocks of about ``ENTRIES`` (item, term) pairs; only a block's terms, weights
    and bounds are sent to tasks. Documents become sparse impact vectors over those terms, dealt
    to ranges of their norm and sorted by it. The range of the largest norms is searched first; the
    ``k``-th score found there is a floor for all others. A range skips an item where the product
    of norms stays below the floor, inside a bucket the heaviest coordinates bound what a document
    can reach, and survivors are scored in integers.

    Null and empty texts have no terms and are in no result, nor does an item without terms give
    rows. A null ``doc_id`` counts as a document and sorts before others at a tie; repeated rows
    are documents of their own. Rows with one ``item_id``, null included, are one item. Texts of any
    length are read whole, empty tables give no rows, and further columns are ignored.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "lexical")
    entries = scratch.settle(item_terms(items))
    blocks = max(1, -(-entries.count() // ENTRIES))
    out = None
    for block in range(blocks):
        mine = entries.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block)
        found = _block(docs, mine.orderBy("item_id", "term").collect(), k, scratch)
        if found is not None:
            out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], RESULT) if out is None else out


def _block(docs: DataFrame, entries: list, k: int, scratch: Scratch) -> DataFrame | None:
    vocabulary: dict[bytes, int] = {}
    items, start, term = [], [], []
    for item_id, word in entries:
        if not items or items[-1] != item_id:
            items.append(item_id)
            start.append(len(term))
        term.append(vocabulary.setdefault(bytes(word), len(vocabulary)))
    vectors = scratch.settle(counted(docs, vocabulary))
    n = F.col("n")
    documents, occurrences = vectors.agg(F.count(F.when(n > 0, n)), F.sum(n)).first()
    if not items or not documents:
        return None
    holding = np.zeros(len(vocabulary), np.int64)
    for row in vectors.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
        holding[row["term"]] = row["count"]
    weight = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * int(d) + 1))) for d in holding], np.int64)
    queries = Queries(items, np.array([*start, len(term)]), np.array(term, np.int64)).weighted(weight)

    order = [F.col("norm").desc(), F.col("doc_id")]
    index = scratch.settle(
        impacts(vectors, weight, documents, occurrences)
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("range", F.spark_partition_id())
    )
    scratch.discard(vectors)
    columns = ["doc_id", "terms", "impacts", "norm"]
    least = np.zeros(len(items), np.int64)
    first = index.where(F.col("range") == 0).select(*columns).mapInArrow(_search(queries, least, k), _FOUND)
    for row in _top(first, k).where(F.col("rank") == k).collect():
        least[row["query"]] = row["score"]
    found = index.select(*columns).mapInArrow(_search(queries, least, k), _FOUND)
    names = docs.sparkSession.createDataFrame(list(enumerate(items)), "own long, item_id long")
    return (
        _top(found, k)
        .join(F.broadcast(names), F.col("query") == F.col("own"))
        .select("item_id", "rank", F.when(F.col("doc_id") != _NULL, F.col("doc_id")).alias("doc_id"), "score")
    )
