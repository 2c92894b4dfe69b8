"""Language identification: codes, n-grams and decoding against plain loops, accuracy on held-out rows."""

import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import language
from tidemark.llm.common import Scratch

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id bigint, text string, lang string, score string, lang_pred string, r string, no string"


@pytest.mark.parametrize("languages", [2, 3, 4, 7, 8, 30])
def test_codes_tell_languages_apart(languages):
    code = language.codewords(languages)
    assert len({tuple(w) for w in code.tolist()}) == languages
    columns = {tuple(c) for c in code.T.tolist()}
    assert len(columns) == code.shape[1] and not any(tuple(-x for x in c) in columns for c in columns)
    assert all(len(set(c)) == 2 for c in columns)
    far = min(sum(a != b for a, b in zip(code[i], code[j], strict=True)) for i in range(languages) for j in range(i))
    assert language.distance(code) == far
    if languages <= language.EXHAUSTIVE:
        assert far == 1 << max(0, languages - 2)
    else:
        assert far >= 5


def _cells(text):
    data, found = language.cleaned(text), []
    for n in language.GRAMS:
        for k in range(len(data) - n + 1):
            code = sum(b << 8 * j for j, b in enumerate(data[k : k + n]))
            code = (code * 0x9E3779B1 + 0x85EBCA6B * n) & 0xFFFFFFFF
            code = ((code ^ code >> 15) * 0x2C1B3C6D) & 0xFFFFFFFF
            found.append(code >> 32 - language.BITS)
    return found


TEXTS = ["Ab cd", "", None, "É 1 x-y", "z", "日本語 text", "a" * 50, " . "]


@pytest.mark.parametrize("limit", [1, 2, 3, 7, 10_000])
def test_ngrams_in_pieces(limit):
    found = [[] for _ in TEXTS]
    for cells, first, doc in language.runs(TEXTS, limit):
        for d, own in zip(doc, np.split(cells, first[1:]), strict=True):
            found[d] += own[own < 1 << language.BITS].tolist()
    assert [sorted(f) for f in found] == [sorted(_cells(t)) for t in TEXTS]


def test_margins_and_decoding():
    rng = np.random.default_rng(4)
    code = language.codewords(4)
    weights = rng.normal(size=(7, (1 << language.BITS) + 1)).astype(np.float32)
    weights[:, -1] = 0
    slope, offset, trust = rng.normal(size=7), rng.normal(size=7), rng.uniform(0.5, 1.5, (4, 7))
    model = language.Model(list("abcd"), code, weights, slope, offset, trust)
    found = language.margins(TEXTS, weights)
    best, share, unsure = model.decode(found)
    for k, text in enumerate(TEXTS):
        cells = _cells(text)
        want = [sum(float(w[c]) for c in cells) / max(len(cells), 1) for w in weights]
        assert np.allclose(found[k], want)
        signed = [w * s + o for w, s, o in zip(want, slope, offset, strict=True)]
        loss = [sum(t * math.log1p(math.exp(-y * f)) for t, y, f in zip(trust[m], code[m], signed, strict=True)) for m in range(4)]
        share_ = math.exp(-min(loss)) / sum(math.exp(-x) for x in loss)
        assert best[k] == loss.index(min(loss)) and math.isclose(share[k], share_, rel_tol=1e-6)
        wrong = sum((f >= 0) != (y > 0) for f, y in zip(signed, code[best[k]], strict=True))
        assert unsure[k] == (share_ < language.SURE or wrong > 1)


def test_one_wrong_bit_is_corrected():
    """With four languages any single classifier may fail."""
    code = language.codewords(4)
    model = language.Model(list("abcd"), code, np.zeros((7, 1)), np.ones(7), np.zeros(7), np.ones((4, 7)))
    for k, word in enumerate(code):
        for b in range(7):
            margin = 5.0 * word
            margin[b] *= -1
            assert model.decode(margin[None, :])[0][0] == k


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    model = language.fit(docs.where(fold != 0), Scratch(spark, "t"))
    assert model.languages == ["de", "en", "es", "fr"]
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    rows = language.predict(docs, model).collect()
    assert len(rows) == len(truth) and all(0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    right = [r.lang_pred == truth[r.doc_id] for r in held]
    assert sum(right) >= 0.97 * len(right)
    sure = [ok for r, ok in zip(held, right, strict=True) if not r.ambiguous]
    assert sum(sure) >= 0.98 * len(sure) and len(sure) >= 0.9 * len(held)
    assert [tuple(r) for r in sorted(language.predict(docs.repartition(7), model).collect())] == [tuple(r) for r in sorted(rows)]


def _table(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z", "w") for r in rows], SCHEMA)


def test_odd_rows(spark):
    train = _table(spark, [(k, "the cat and the dog " * (k % 3 + 1), "en") for k in range(30)] + [(100 + k, "der hund und die katze", "de") for k in range(30)] + [(None, "le chat", "fr"), (7, None, "en"), (8, "le chat", None)])
    model = language.fit(train, Scratch(spark, "t"))
    assert model.languages == ["de", "en"]
    odd = [(1, None, "q"), (2, "", None), (3, "12 ... !", None), (4, "the dog", "de"), (4, "the dog", "de"), (None, "die katze", None), (5, "und die katze " * 40_000, None), (6, "½ ²", None)]
    found = sorted(((r.doc_id or 0), r.lang_pred, r.score == 0, r.ambiguous) for r in language.predict(_table(spark, odd), model).collect())
    assert [(i, p) for i, p, *_ in found] == [(0, "de"), (1, "und"), (2, "und"), (3, "und"), (4, "en"), (4, "en"), (5, "de"), (6, "und")]
    assert all(zero == (p == "und") and (unsure or p != "und") for _, p, zero, unsure in found)
    assert language.predict(_table(spark, []), model).collect() == []


def test_one_language_or_none(spark):
    one = language.fit(_table(spark, [(1, "hola", "es"), (2, None, "es")]), Scratch(spark, "t"))
    odd = _table(spark, [(1, "x", None), (2, "-", None)])
    assert [tuple(r) for r in language.predict(odd, one).orderBy("doc_id").collect()] == [(1, "es", 1.0, False), (2, "und", 0.0, True)]
    none = language.fit(_table(spark, []), Scratch(spark, "t"))
    assert {r.lang_pred for r in language.predict(odd, none).collect()} == {"und"}
    two = language.fit(_table(spark, [(1, "hola", "es"), (2, "hello", "en")]), Scratch(spark, "t"))
    assert [r.lang_pred for r in language.predict(_table(spark, [(1, "hello", "")]), two).collect()] == ["en"]
