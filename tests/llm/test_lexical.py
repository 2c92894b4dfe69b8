"""Lexical search against scores of all pairs in plain Python."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import lexical

DOCS = "doc_id bigint, text string, norm string, terms string, n string, range string, query string"
ITEMS = "item_id bigint, text string, term string, own string"
ASCII = str.maketrans(lexical.UPPER, lexical.LOWER)


def split(text):
    return re.findall(lexical.PATTERN, (text or "").translate(ASCII))


def expected(docs, items, k=10):
    split_docs = [(i, Counter(split(t))) for i, t in docs]
    sizes = [sum(c.values()) for _, c in split_docs]
    many, total = sum(n > 0 for n in sizes), sum(sizes)
    df = Counter(t for _, c in split_docs for t in c)
    merged = {}
    for i, text in items:
        merged.setdefault(i, set()).update(split(text))
    out = []
    for i, own in merged.items():
        found = []
        for (doc_id, c), n in zip(split_docs, sizes, strict=True):
            score = 0
            for t in own & set(c):
                w = math.floor(1000 * math.log((2 * many + 2) / (2 * df[t] + 1)))
                score += w * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * (100 - 90 + (90 * n * many) // total)))
            if score > 0:
                found.append((-score, doc_id is not None, doc_id or 0))
        for rank, (score, there, doc_id) in enumerate(sorted(found)[:k], 1):
            out.append((i, rank, doc_id if there else None, -score))
    return sorted(map(repr, out))


def found(spark, docs, items, parts=3, **more):
    d = spark.createDataFrame([(*r, "a", "b", "c", "d", "e") for r in docs], DOCS).repartition(parts)
    b = spark.createDataFrame([(*r, "x", "y") for r in items], ITEMS)
    return sorted(repr(tuple(r)) for r in lexical.search(d, b, **more).collect())


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=30))
def test_terms_are_those_of_the_pattern(text):
    assert [t.decode() for t in lexical.terms(text.encode())] == split(text)


def _corpus(n, seed=3):
    rng = random.Random(seed)
    vocabulary = [f"{c}{k}" for c in ("a", "É", "日", "x") for k in range(60)]
    weights = [1 / (k + 1) for k in range(len(vocabulary))]
    docs = [(k, " ".join(rng.choices(vocabulary, weights, k=rng.choice([1, 5, 40, 200])))) for k in range(n)]
    items = [(k, "; ".join(rng.choices(vocabulary, k=rng.choice([1, 3, 25])))) for k in range(25)]
    return docs, items


def test_random_corpus(spark):
    docs, items = _corpus(500)
    assert found(spark, docs, items) == expected(docs, items)


def test_blocks_of_items(spark, monkeypatch):
    docs, items = _corpus(200, 8)
    monkeypatch.setattr(lexical, "ENTRIES", 60)
    assert found(spark, docs, items) == expected(docs, items)


def test_odd_rows(spark):
    docs = [(1, "A b; C"), (1, "A b; C"), (2, "a B c"), (None, "a b c"), (None, None), (3, ""), (4, "!!! \x00 ~"), (5, "a " * 60_000 + "tail"), (6, "é É")]
    docs += [(k, "same words here") for k in range(20, 60)]
    items = [(7, "a, b"), (7, "tail É"), (None, "same same here"), (8, None), (9, ""), (10, "unknown"), (11, "?! -")]
    assert found(spark, docs, items) == expected(docs, items)
    assert found(spark, docs, items, k=2) == expected(docs, items, 2)


def test_empty_tables(spark):
    docs, items = _corpus(10)
    d, b = spark.createDataFrame([], DOCS), spark.createDataFrame([], ITEMS)
    assert lexical.search(d, spark.createDataFrame([(*r, "", "") for r in items], ITEMS)).collect() == []
    assert lexical.search(spark.createDataFrame([(*r, *"abcde") for r in docs], DOCS), b).collect() == []


@pytest.mark.parametrize("seed", range(6))
def test_bounds_never_lose_a_document(seed):
    """Survivors for any floor include all documents whose score reaches it, and floors prune some."""
    rng = np.random.default_rng(seed)
    weight = rng.integers(0, 9000, 40)
    rows = [(k, sorted(rng.choice(40, rng.integers(1, 20), replace=False).tolist())) for k in range(300)]
    values = [rng.integers(1, 1_000_000, len(t)).tolist() for _, t in rows]
    root = np.sqrt(weight.astype(float))
    norms = [float(np.sqrt(np.sum((root[t] * v) ** 2))) for (_, t), v in zip(rows, values, strict=True)]
    part = pa.record_batch(
        [pa.array([k for k, _ in rows]), pa.array([t for _, t in rows], pa.list_(pa.int32())), pa.array(values, pa.list_(pa.int32())), pa.array(norms)],
        ["doc_id", "terms", "impacts", "norm"],
    ).slice(20, 250)
    bucket, pruned = lexical.Bucket(part, root), 0
    for _ in range(20):
        query = rng.choice(40, rng.integers(1, 15), replace=False)
        query = query[weight[query] > 0]
        if not len(query):
            continue
        query = query[np.argsort(-weight[query])]
        own = np.zeros(40, np.int64)
        own[query] = weight[query]
        want = np.array([sum(int(own[t]) * v for t, v in zip(rows[k][1], values[k], strict=True)) for k in range(20, 270)])
        assert (bucket.scores(np.arange(250), own) == want).all()
        for floor in np.quantile(want[want > 0], [0.1, 0.5, 0.99, 1.0]):
            kept = bucket.survivors(query, root, float(floor))
            assert set(np.flatnonzero(want >= floor)) <= set(kept)
            pruned += 250 - len(kept)
    assert pruned
