"""Language of a text by error-correcting output codes over byte n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import SLICE_BYTES, Scratch, cell_counts, mapper

#: Labelled documents of a language that a fit uses at most, chosen by a hash of their id.
SAMPLE = 4_000
#: Lengths of n-grams in bytes, their hash space, and what each cell counts before any text.
GRAMS = (2, 3)
BITS = 16
PRIOR = 0.5
#: Up to this many languages a code has every split of them in two.
EXHAUSTIVE = 7
#: A score below it counts as ambiguous.
SURE = 0.9
UNKNOWN = "und"

_WORD = bytes(c if c >= 0x80 or chr(c).isalpha() else 0x20 for c in range(256))
_CELLS = 1 << BITS


# --- codes ----------------------------------------------------------------------------------


def codewords(languages: int, seed: int = 17) -> np.ndarray:
    """A row of -1 and 1 for each language, a column for each classifier; columns differ, also from their opposites.

    Few languages get the exhaustive code. For more, the best of 200 random codes of ten columns a
    bit stays: the one whose closest two rows are furthest apart.
    """
    if languages < 2:
        return np.ones((languages, 0), np.int8)
    if languages <= EXHAUSTIVE:
        splits = np.arange(1, 1 << (languages - 1))  # the first language is always on the side of 1
        return np.where(splits[None, :] >> np.arange(languages)[::-1][:, None] & 1, -1, 1).astype(np.int8)
    rng, best, far = np.random.default_rng(seed), None, -1
    width = 10 * int(np.ceil(np.log2(languages)))
    for _ in range(200):
        code = rng.choice(np.array([-1, 1], np.int8), (languages, width))
        code = np.unique(code * code[0], axis=1)
        code = code[:, np.abs(code.sum(axis=0, dtype=np.int64)) < languages]  # a classifier has two sides
        if distance(code) > far:
            best, far = code, distance(code)
    return best


def distance(code: np.ndarray) -> int:
    """Columns in which the closest two rows differ."""
    if len(code) < 2:
        return code.shape[1]
    wide = code.astype(np.int64)
    same = wide @ wide.T
    np.fill_diagonal(same, -code.shape[1])
    return int((code.shape[1] - same.max()) // 2)


# --- features -------------------------------------------------------------------------------


def cleaned(text: str | None) -> bytes:
    """Words in lower case with one space around each; ASCII that is no letter parts words."""
    return b" " + b" ".join((text or "").lower().encode("utf-8", "surrogatepass").translate(_WORD).split()) + b" "


def has_letter(text: str | None) -> bool:
    return any(map(str.isalpha, text or ""))


def runs(texts: list[str | None], limit: int = SLICE_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Cells of all n-grams, a bounded piece at a time: ``(cells, first of each text here, text)``.

    An n-gram that would run over the end of its text has the cell after the last.
    """
    parts = [cleaned(t) for t in texts]
    data = np.frombuffer(b"".join(parts), np.uint8)
    ends = np.cumsum([len(p) for p in parts])
    for low in range(0, len(data), limit):
        high = min(low + limit, len(data))
        doc = np.arange(np.searchsorted(ends, low, side="right"), np.searchsorted(ends, high - 1, side="right") + 1)
        first = np.maximum(np.concatenate(([0], ends))[doc], low) - low
        for n in GRAMS:
            piece = data[low : high + n - 1].astype(np.uint32)
            code = np.zeros(high - low, np.uint32)
            for k in range(n):
                there = piece[k : k + high - low]
                code[: len(there)] |= there << np.uint32(8 * k)
            code = code * np.uint32(0x9E3779B1) + np.uint32(0x85EBCA6B * n & 0xFFFFFFFF)
            code = (code ^ code >> np.uint32(15)) * np.uint32(0x2C1B3C6D)
            cells = (code >> np.uint32(32 - BITS)).astype(np.int64)
            for k in range(1, n):
                over = ends[doc] - k - low
                cells[over[(over >= 0) & (over < high - low)]] = _CELLS
            yield cells, first, doc


def margins(texts: list[str | None], weights: np.ndarray) -> np.ndarray:
    """The mean weight of each text's n-grams, a column for each classifier."""
    total, seen = np.zeros((len(texts), len(weights))), np.zeros(len(texts))
    for cells, first, doc in runs(texts):
        seen[doc] += np.add.reduceat(cells < _CELLS, first, dtype=np.int64)
        for b, own in enumerate(weights):
            total[doc, b] += np.add.reduceat(own[cells], first, dtype=np.float64)
    return total / np.maximum(seen, 1)[:, None]


# --- model ----------------------------------------------------------------------------------


@dataclass
class Model:
    """``weights`` of n-grams by classifier, its slope and offset, and the ``trust`` of each language in it."""

    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    slope: np.ndarray
    offset: np.ndarray
    trust: np.ndarray

    def decode(self, margin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The nearest codeword of each row, its share and whether the answer is ambiguous.

        A codeword's distance is the logistic loss of its bits, weighted by trust. Ambiguous is a
        share below ``SURE``, or signs that differ from the codeword in more bits than the code corrects.
        """
        signed = margin * self.slope + self.offset
        loss = np.stack([np.logaddexp(0, -signed * word) @ trust for word, trust in zip(self.code, self.trust, strict=True)], axis=1)
        share = np.exp(loss.min(axis=1, keepdims=True) - loss)
        best = np.argmin(loss, axis=1)
        share = 1 / share.sum(axis=1)
        wrong = (np.where(signed >= 0, 1, -1) != self.code[best]).sum(axis=1)
        return best, share, (share < SURE) | (wrong > max(0, (distance(self.code) - 1) // 2))


def _classifiers(counts: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Log-odds of each n-gram between the languages of either side, every language counting alike."""
    shares = (counts + PRIOR) / (counts.sum(axis=1, keepdims=True) + PRIOR * _CELLS)
    out = np.zeros((code.shape[1], _CELLS + 1), np.float32)
    for b, side in enumerate(code.T):
        out[b, :_CELLS] = np.log(shares[side > 0].mean(axis=0)) - np.log(shares[side < 0].mean(axis=0))
    return out


def _line(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve through ``y`` (-1 or 1), by Newton steps with a small ridge."""
    scale = float(np.abs(x).mean()) or 1.0
    a, theta = np.stack([x / scale, np.ones_like(x)], axis=1), np.zeros(2)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a @ theta, -30, 30)))
        slope = a.T @ (weight * (p - (y > 0))) + 1e-3 * theta
        bend = (a * (weight * p * (1 - p))[:, None]).T @ a + 1e-3 * np.eye(2)
        theta -= np.linalg.solve(bend, slope)
    return float(theta[0] / scale), float(theta[1])


def fit(docs: DataFrame, scratch: Scratch, sample: int = SAMPLE, seed: int = 19) -> Model:
    """Learn from ``(doc_id, text, lang)`` rows with an id and a language, ``sample`` ids a language at most.

    Half of them counts n-grams for the classifiers; the other half sets their curves and how far
    each language may trust them. Tasks count; what comes to the driver is one array a language and
    the margins of sampled documents. No language gives a model that answers ``und``, one always that one.
    """
    # a name of its own for each column, whatever else the table has
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    rows = rows.where("doc_id is not null and lang is not null")
    order = Window.partitionBy("lang").orderBy("h", "doc_id")
    chosen = rows.select("doc_id", "lang", F.xxhash64("doc_id", F.lit(seed)).alias("h")).distinct()
    chosen = scratch.settle(chosen.withColumn("r", F.row_number().over(order)).where(F.col("r") <= sample).select("doc_id", "lang", "r"))
    languages = sorted(r[0] for r in chosen.select("lang").distinct().collect())
    code = codewords(len(languages))
    if code.shape[1] == 0:
        none = np.zeros(0)
        return Model(languages, code, np.zeros((0, _CELLS + 1), np.float32), none, none, np.ones(code.shape))
    number = docs.sparkSession.createDataFrame(list(enumerate(languages)), "no int, lang string")
    taken = rows.join(F.broadcast(chosen) if len(languages) * sample <= 100_000 else chosen, ["doc_id", "lang"])
    taken = scratch.settle(taken.join(F.broadcast(number), "lang").select("doc_id", "text", "no", "r"))

    def cells(part: pa.RecordBatch) -> np.ndarray:
        texts, no = part["text"].to_pylist(), np.asarray(part["no"], np.int64)
        found = []
        for own, first, doc in runs(texts):
            at = np.repeat(no[doc], np.diff([*first, len(own)]))
            found.append((at << BITS | own)[own < _CELLS])
        return np.concatenate([*found, np.zeros(0, np.int64)])

    bits = BITS + int(np.ceil(np.log2(len(languages))))
    counts = cell_counts(taken.where("r % 2 = 1"), cells, ["text", "no"], bits).reshape(-1, _CELLS)[: len(languages)]
    weights = _classifiers(counts.astype(float), code)
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def measured(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        found = margins(part["text"].to_pylist(), shared.value)
        yield pa.RecordBatch.from_arrays([part["doc_id"], part["no"], pa.array(found.tolist(), pa.list_(pa.float64()))], ["doc_id", "no", "margin"])

    wide = taken.where("r % 2 = 0").select("doc_id", "no", "text").mapInArrow(mapper(measured), "doc_id bigint, no int, margin array<double>")
    # an id that comes often counts once
    known = wide.groupBy("doc_id", "no").agg(F.min("margin").alias("margin")).orderBy("no", "doc_id").collect()
    no = np.array([r["no"] for r in known], np.int64)
    x = np.array([r["margin"] for r in known], float).reshape(-1, code.shape[1])
    alike = 1 / np.maximum(np.bincount(no, minlength=len(languages)), 1)[no]
    lines = [_line(x[:, b], code[no, b], alike) if len(x) else (1.0, 0.0) for b in range(code.shape[1])]
    slope, offset = (np.array(v) for v in zip(*lines, strict=True))
    right = np.where(x * slope + offset >= 0, 1, -1) == code[no]
    trust = np.stack([(right[no == k].sum(axis=0) + 1) / ((no == k).sum() + 2) for k in range(len(languages))])
    return Model(languages, code, weights, slope, offset, trust / trust.mean(axis=1, keepdims=True))


PREDICTED = "doc_id bigint, lang_pred string, score double, ambiguous boolean"


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, lang_pred, score, ambiguous)`` row by row, without a shuffle.

    Null and empty texts and those without a letter get ``und``, score 0, and are ambiguous. Null ids
    and repeated rows are answered like any row, texts of any length read whole, in pieces. Further
    columns are ignored, an empty table gives no rows. A tie goes to the language that sorts first.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def answer(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        own, texts = shared.value, part["text"].to_pylist()
        known = np.array([has_letter(t) for t in texts]) & bool(own.languages)
        if own.code.shape[1]:
            best, share, unsure = own.decode(margins(texts, own.weights))
        else:
            best, share, unsure = np.zeros(len(texts), int), np.ones(len(texts)), np.zeros(len(texts), bool)
        names = [own.languages[k] if fine else UNKNOWN for k, fine in zip(best, known, strict=True)]
        yield pa.RecordBatch.from_arrays(
            [part["doc_id"], pa.array(names), pa.array(np.where(known, share, 0.0)), pa.array(unsure | ~known)],
            ["doc_id", "lang_pred", "score", "ambiguous"],
        )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(mapper(answer), PREDICTED)
