"""Merkle manifests against trees built level by level in plain Python."""

import random
import zlib
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tidemark.llm import merkle

COLUMNS = ["doc_id", "source", "lang", "n_chars", "text", "tree", "pos", "leaf", "at"]
SCHEMA = StructType(
    [StructField(c, LongType() if c in ("doc_id", "n_chars") else StringType()) for c in COLUMNS]
)


def digest(text):
    return sha256(text.encode()).hexdigest()


def leaf_of(row, text):
    fields = [row[0], row[1], row[2], row[3], text]
    return digest("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in fields))


def levels_of(hashes):
    out = [hashes]
    while len(out[-1]) > 1:
        out.append([digest("".join(out[-1][k : k + 16])) for k in range(0, len(out[-1]), 16)])
    return out


def path_of(levels, at):
    found = []
    for level in levels[:-1]:
        run = at // 16 * 16
        found.append((level[run:at], level[at + 1 : run + 16]))
        at //= 16
    return found


def expected(rows):
    """The contract, word by word."""
    by = {}
    for row in rows:
        text = row[4]
        if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0 and text is not None:
            text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        by.setdefault(row[1], []).append((row[0], leaf_of(row, row[4]), leaf_of(row, text)))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for name in names:
        by[name].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        trees[name] = levels_of([r[1] for r in by[name]])
    top = levels_of([trees[n][-1][0] for n in names])
    out = []
    for k, name in enumerate(names):
        for at, (doc_id, leaf, claimed) in enumerate(by[name]):
            path = path_of(trees[name], at) + path_of(top, k)
            now = claimed
            for left, right in path:
                now = digest("".join([*left, now, *right]))
            proof = digest("".join("".join(a + b) for a, b in path))
            root = top[-1][0]
            out.append((doc_id, leaf, trees[name][-1][0], root, proof, now, now == root))
    return sorted(map(repr, out))


def found(df):
    made = merkle.proofs(merkle.manifest(df, merkle.lowered_in_fold()))
    return sorted(repr(tuple(r)) for r in made.collect())


@pytest.mark.parametrize("height", [0, 1, 2, 3, 5])
def test_every_node_has_an_address_of_its_own(height):
    if height > 3:
        assert merkle.cuts(5) == [3, 2] and merkle.cuts(8) == [2, 2, 2, 2] and merkle.cuts(12) == [3, 3, 3, 3]
        return
    places = np.concatenate([merkle.address(height + 1, d, np.arange(16**d)) for d in range(height + 1)])
    assert sorted(places) == list(range(merkle.nodes_in(height + 1)))
    # the children of one node of the lower half lie side by side
    if height == 3:
        assert merkle.address(4, 2, np.array([5]))[0] + 1 == merkle.address(4, 3, np.array([80]))[0]


@pytest.mark.parametrize("leaves", [1, 2, 15, 16, 17, 255, 256, 257, 4096])
def test_blocks_are_trees(leaves):
    hashes = [digest(str(k)) for k in range(leaves)]
    levels = levels_of(hashes)
    height = len(levels) - 1
    store = merkle.block([bytes.fromhex(h) for h in hashes], height)
    assert store[0].tobytes().hex() == levels[-1][0]
    siblings = merkle.Siblings(store.tobytes(), height, leaves)
    for at in {0, leaves // 2, leaves - 1}:
        assert siblings.of(at) == [("".join(a), "".join(b)) for a, b in path_of(levels, at)]


def test_odd_rows(spark):
    rng = random.Random(5)
    rows = [(k, rng.choice(["a", "B", "é", None, "a"]), "en", k, f"Text {k}") for k in range(400)]
    rows += [(7, "a", "en", 7, "Text 7"), (7, "a", "en", 7, "Text 7"), (7, "a", None, None, None), (None, "a", None, 1, "X"), (None, None, "", 0, "")]
    rows += [(1000 + k, f"one{k}", "de", 1, "ÄB" * k) for k in range(40)] + [(5000, "long", "en", 1, "Zz é" * 60_000)]
    df = spark.createDataFrame([(*r, "clash", "clash", "clash", "clash") for r in rows], SCHEMA)
    assert found(df) == expected(rows)


@pytest.mark.parametrize("edges", [1, 2])
def test_blocks_recurse_over_their_roots(spark, monkeypatch, edges):
    """Small blocks make several tiers of 700 leaves; cut heights travel with the rows."""
    monkeypatch.setattr(merkle, "EDGES", edges)
    rows = [(k, "hot" if k % 3 else f"s{k % 70:02d}", "en", k, "T" * (k % 5)) for k in range(1000)]
    df = spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], SCHEMA).repartition(5)
    assert found(df) == expected(rows)


def test_empty_and_single(spark):
    none = spark.createDataFrame([], SCHEMA)
    made = merkle.manifest(none)
    assert made.root() is None and merkle.proofs(made).collect() == []
    one = spark.createDataFrame([(3, None, "en", 1, None, "", "", "", "")], SCHEMA)
    assert found(one) == expected([(3, None, "en", 1, None)])


def test_an_untouched_table_verifies(spark):
    df = spark.range(300).select(
        F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.lit("en").alias("lang"), F.lit(1).alias("n_chars"), F.lit("Abc").alias("text")
    )
    made = merkle.manifest(df)
    assert all(r.verified and r.root == made.root() for r in merkle.proofs(made).collect())
