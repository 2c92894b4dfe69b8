"""The kept index against the scan form."""

import random

from pyspark.sql import functions as F

from tidemark.operators import catalog
from tidemark.plans import text_index
from tidemark.plans.text_index import TextIndex

SCHEMA = "path string, body string, deleted boolean"


def _bodies(spark, texts):
    return spark.createDataFrame([(p, b) for p, b in texts.items()], "path string, body string")


def _same(spark, index, texts, words, limit):
    found = index.search(words, limit)
    got = [tuple(r) for r in found.rows.collect()]
    want = [(r.path, r.score) for r in catalog.search(_bodies(spark, texts), words, limit).collect()]
    assert got == want
    return found


def test_refresh_and_skip(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(text_index, "SEGMENT_DOCS", 60)
    monkeypatch.setattr(text_index, "BLOCK_DOCS", 8)
    rng = random.Random(4)
    words = [f"w{k}" for k in range(30)] + ["É", "日本"]
    texts = {f"p{k:03d}": " ".join(rng.choices(words, k=rng.choice([0, 3, 20, 150]))) for k in range(300)}
    texts["p000"], texts["p001"] = "", None
    index = TextIndex(spark, str(tmp_path))
    assert index.search(["w1"], 3).rows.collect() == []
    index.refresh(spark.createDataFrame([(p, b, False) for p, b in texts.items()], SCHEMA))
    found = _same(spark, index, texts, ["W1", "é", "none"], 5)
    # long documents are in blocks of their own: the bound shuts the others out
    assert found.blocks > 20 and found.read < found.blocks / 2
    _same(spark, index, texts, ["w2", "w3", "日本"], 400)
    before = index.current().tables
    texts["p010"] = "w1 " * 500
    del texts["p011"]
    texts["p999"] = "w1 é"
    changes = [("p010", texts["p010"], False), ("p011", None, True), ("p999", texts["p999"], False), ("never", "w1", True)]
    written = index.refresh(spark.createDataFrame(changes, SCHEMA))
    kept = [n for n, f in index.current().tables.items() if before.get(n) == f]
    assert len(written) <= 4 and len(kept) == len(before) - 2 * len(written) or len(written) == 4
    assert _same(spark, index, texts, ["w1", "é"], 6).rows.first()["path"] == "p010"
    df = {r.term: r.df for r in index.frequencies().collect()}
    assert df["w1"] == sum("w1" in (b or "").split() for b in texts.values())
    plan = index._read(index.current(), "blocks", text_index.BLOCKS).where(F.col("term").isin("w1"))
    assert "PushedFilters: [IsNotNull(term), EqualTo(term,w1)]" in plan._jdf.queryExecution().executedPlan().toString()
