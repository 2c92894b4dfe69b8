"""Toxicity by multiple-instance learning: sentences scored, documents labelled."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, binary, joined, mapper, mix, texts, words

#: Labelled rows a fit uses at most, chosen by a hash of their id.
SAMPLE = 8_000
#: Hash space of words, words with a weight, and documents a weighted word is in at least.
BITS = 20
WEIGHTED = 512
SEEN = 4
#: Lengths of word beginnings that are features too, and the ridge penalty.
HEADS = (4, 5, 6)
DECAY = 0.01
THRESHOLD = 0.7

_KEEP = bytes(c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256))
_END = np.zeros(256, dtype=bool)
_END[[ord(c) for c in ".!?\n"]] = True


def sentences(column: pa.Array) -> tuple[np.ndarray, ...]:
    """Features with their sentence, and each sentence's document, start and end in bytes.

    A sentence ends at ``.``, ``!``, ``?`` or a line feed; those without a word are left out.
    Letters A-Z count as lower case, and ASCII that is no letter or digit parts words. A word gives
    itself and its first 4, 5 and 6 bytes, so that endings a fit never saw still count.
    """
    buffer, starts = joined(column, lower=True)
    clean = buffer.translate(_KEEP)
    hashes, at, stop = words(clean)
    data = np.frombuffer(clean, np.uint8).astype(np.uint64)
    found, owner, head = [hashes], [np.arange(len(at))], np.zeros(len(at), np.uint64)
    for k in range(max(HEADS)):
        reach = at + k < stop
        head[reach] = mix(head[reach] ^ data[at[reach] + k])
        if k + 1 in HEADS:
            found.append(head[reach] + np.uint64(k))
            owner.append(np.flatnonzero(reach))
    ends = np.flatnonzero(_END[np.frombuffer(buffer, np.uint8)])
    used, inner = np.unique(np.searchsorted(ends, at), return_inverse=True)
    begin = np.concatenate(([0], ends + 1))[used]
    end = ends[used] if len(used) else ends[:0]
    doc = np.searchsorted(starts, begin, side="right") - 1
    features = (mix(np.concatenate(found)) >> np.uint64(64 - BITS)).astype(np.int64)
    return features, inner[np.concatenate(owner)], doc, begin - starts[doc], end - starts[doc]


@dataclass
class Model:
    bias: float
    weights: np.ndarray

    def sentence_scores(self, features, inner, count: int) -> np.ndarray:
        z = self.bias + np.bincount(inner, self.weights[features], minlength=count)
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def noisy_or(p: np.ndarray, doc: np.ndarray, docs: int) -> np.ndarray:
    """A document is toxic unless each of its sentences is not."""
    return -np.expm1(np.bincount(doc, np.log1p(-np.minimum(p, 1 - 1e-12)), minlength=docs))


def fit(docs: DataFrame, labelled: DataFrame, label: str, scratch: Scratch, sample: int = SAMPLE, seed: int = 13) -> Model:
    """Learn word weights from document labels alone, on at most ``sample`` labelled rows.

    Tasks turn the sampled texts into hashed words; the bounded rest is fitted by the driver. Words
    that tell labels apart in document counts get weights, by gradient steps on the noisy-or
    likelihood. Labels other than 0 and 1 and null ids are ignored; a doc_id labelled twice counts
    by its largest label. With one class or none among the documents at hand every score is near 0
    or, all toxic, near 1.
    """
    chosen = (
        labelled.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("__label"))
        .where("doc_id is not null and __label in (0, 1)")
        .groupBy("doc_id")
        .agg(F.max("__label").alias("__label"))
        .orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id")
        .limit(sample)
    )
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")

    def distinct(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        features, inner, doc, *_ = sentences(part["text"])
        once = np.unique(doc[inner] << BITS | features)
        toxic = np.asarray(part["__label"])[once >> BITS]
        yield pa.RecordBatch.from_arrays([pa.array(once & ((1 << BITS) - 1)), pa.array(toxic)], ["feature", "toxic"])

    classes = dict(rows.groupBy("__label").count().collect())
    weights = np.zeros(1 << BITS)
    if len(classes) < 2:
        return Model(4.0 if classes.get(1) else -12.0, weights)
    share = classes[1] / sum(classes.values())
    counts = rows.select("text", "__label").mapInArrow(mapper(distinct), "feature bigint, toxic int")
    seen = counts.groupBy("feature").agg(F.count("*").alias("n"), F.sum("toxic").alias("t")).where(F.col("n") >= SEEN)
    surprise = F.abs(F.col("t") - F.col("n") * share) / F.sqrt(F.col("n") * share * (1 - share))
    top = [r[0] for r in seen.orderBy(surprise.desc(), "feature").limit(WEIGHTED).select("feature").collect()]
    column = np.full(1 << BITS, -1)
    column[top] = np.arange(len(top))
    picked = docs.sparkSession.sparkContext.broadcast(column.astype(np.int32))

    def bags(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        features, inner, doc, *_ = sentences(part["text"])
        of = picked.value[features]
        order = np.argsort(inner[of >= 0], kind="stable")
        at, of = inner[of >= 0][order], of[of >= 0][order]
        first = np.searchsorted(doc, np.arange(part.num_rows + 1))
        cuts = np.searchsorted(at, first)
        out = [
            np.stack([at[cuts[k] : cuts[k + 1]] - first[k], of[cuts[k] : cuts[k + 1]]]).astype("<u4").tobytes()
            for k in range(part.num_rows)
        ]
        yield pa.RecordBatch.from_arrays(
            [part["__label"], pa.array(np.diff(first)), binary(out)], ["label", "sentences", "bag"]
        )

    gathered = rows.select("text", "__label").mapInArrow(mapper(bags), "label int, sentences bigint, bag binary")
    labels, sizes, pairs = [], [], []
    for label_, size, bag in scratch.settle(gathered).toLocalIterator():
        labels.append(label_)
        pairs.append(np.frombuffer(bag, "<u4").reshape(2, -1).astype(np.int64) + [[sum(sizes)], [0]])
        sizes.append(size)
    at, of = np.concatenate(pairs, axis=1)
    bias, weights[top] = _train(np.array(labels, float), np.array(sizes), at, of, len(top))
    return Model(bias, weights)


def _train(y, sizes, at, of, width: int, steps: int = 500, rate: float = 0.1, decay: float = DECAY):
    """Gradient steps on the noisy-or likelihood; ``at`` and ``of`` are sentence and feature of each hit."""
    owner, n, m = np.repeat(np.arange(len(y)), sizes), len(y), int(sizes.sum())
    w, b = np.zeros(width), -6.0
    moments = [np.zeros(width + 1), np.zeros(width + 1)]
    for step in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(b + np.bincount(at, w[of], minlength=m), -40, 40)))
        whole = np.clip(noisy_or(p, owner, n), 1e-9, 1 - 1e-9)
        pull = np.where(y == 1, -(1 - whole) / whole, 1.0)[owner] * p / n
        slope = np.append(np.bincount(of, pull[at], minlength=width) + decay * w / n, pull.sum())
        moments[0] = 0.9 * moments[0] + 0.1 * slope
        moments[1] = 0.99 * moments[1] + 0.01 * slope**2
        move = rate * (moments[0] / (1 - 0.9**step)) / (np.sqrt(moments[1] / (1 - 0.99**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return float(b), w


SCORED = "doc_id bigint, score double, offending array<struct<start:int,length:int,score:double>>"


def score(docs: DataFrame, model: Model, sentence_threshold: float = 0.5) -> DataFrame:
    """``(doc_id, score, offending)`` row by row, without a shuffle.

    ``offending`` locates sentences of at least the threshold by their bytes in the UTF-8 text.
    Null and empty texts have no sentence: score 0. Null ids and repeated rows are scored like any
    row, texts of any length whole, an empty table gives none. Further columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.bias, model.weights.astype(np.float32)))

    def rows(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        features, inner, doc, begin, end = sentences(part["text"])
        p = own.sentence_scores(features, inner, len(doc))
        found: list[list[dict]] = [[] for _ in range(part.num_rows)]
        for s in np.flatnonzero(p >= sentence_threshold):
            found[doc[s]].append({"start": int(begin[s]), "length": int(end[s] - begin[s]), "score": float(p[s])})
        kind = pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32()), ("score", pa.float64())]))
        yield pa.RecordBatch.from_arrays(
            [part["doc_id"], pa.array(noisy_or(p, doc, part.num_rows)), pa.array(found, type=kind)],
            ["doc_id", "score", "offending"],
        )

    return texts(docs).mapInArrow(mapper(rows), SCORED)
