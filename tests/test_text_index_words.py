"""Words of a refresh reach their blocks as lists: no posting of a new document is shuffled by itself."""

from pyspark.sql import functions as F

from tidemark.operators import catalog
from tidemark.plans.text_index import TextIndex


def test_refreshes_of_odd_documents(spark, tmp_path, monkeypatch):
    """NULL, empty and wordless bodies, one document again and again, an index that loses all documents."""
    from tidemark.plans import text_index

    monkeypatch.setattr(text_index, "BLOCK_DOCS", 2)
    shuffled = []
    write = type(spark.range(1).write).parquet
    monkeypatch.setattr(
        type(spark.range(1).write), "parquet",
        lambda self, path, *a, **k: (shuffled.append((path, self._df._jdf.queryExecution().optimizedPlan().toString())), write(self, path, *a, **k))[1],
    )
    index = TextIndex(spark, str(tmp_path))

    def put(*rows):
        index.refresh(spark.createDataFrame(rows, "path string, body string, deleted boolean"))

    put(("a", "x y x", False), ("b", None, False), ("c", "", False), ("d", "--", False), ("e", "É x", False))
    # the first load counts words in their blocks: they are not exploded into rows
    first = next(p for path, p in shuffled if "blocks/" in path)
    assert "explode(words" not in first
    put(("a", "x", False), ("f", "y y y é", False))
    texts = {"a": "x", "b": None, "c": "", "d": "--", "e": "É x", "f": "y y y é"}
    bodies = spark.createDataFrame(list(texts.items()), "path string, body string")
    want = [(r.path, r.score) for r in catalog.search(bodies, ["x", "y", "é"], 10).collect()]
    assert [tuple(r) for r in index.search(["x", "y", "é"], 10).rows.collect()] == want
    assert {r.term: r.df for r in index.frequencies().collect()} == {"x": 2, "y": 1, "é": 2}
    rows = index._read(index.current(), "blocks", text_index.BLOCKS).where(F.col("term") == "x").collect()
    assert sorted(p.path for r in rows for p in r.postings) == ["a", "e"]
    put(*((k, None, True) for k in texts))
    assert index.frequencies().count() == 0 and index.search(["x"], 3).rows.count() == 0
