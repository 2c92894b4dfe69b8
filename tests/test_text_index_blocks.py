"""Kept blocks of the index are rewritten where they lie: many refreshes against the scan form."""

import random

from pyspark.sql import functions as F

from tidemark.operators import catalog
from tidemark.plans import text_index
from tidemark.plans.text_index import TextIndex


def test_blocks_lose_documents_go_together_and_split(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(text_index, "SEGMENT_DOCS", 30)
    monkeypatch.setattr(text_index, "BLOCK_DOCS", 8)
    plans = []
    writer = type(spark.range(1).write)
    write = writer.parquet

    def watched(self, path, *rest, **more):
        plans.append((path, self._df._jdf.queryExecution().optimizedPlan().toString()))
        return write(self, path, *rest, **more)

    monkeypatch.setattr(writer, "parquet", watched)
    rng = random.Random(6)
    words = [f"w{k}" for k in range(12)] + ["É"]
    index, texts, segments = TextIndex(spark, str(tmp_path)), {}, set()

    def text():
        return rng.choice([None, "", "w1 É-w1", " ".join(rng.choices(words, k=rng.choice([2, 9, 60])))])

    for new, lost in ((50, 0), (40, 30), (70, 20), (3, 90)):
        put = {f"p{rng.randrange(10**6)}": text() for _ in range(new)} | {p: text() for p in rng.sample(sorted(texts), min(5, len(texts)))}
        gone = rng.sample(sorted(set(texts) - set(put)), min(lost, len(texts) - 5) if texts else 0)
        index.refresh(spark.createDataFrame([(p, b, False) for p, b in put.items()] + [(p, None, True) for p in gone], "path string, body string, deleted boolean"))
        texts = {p: b for p, b in (texts | put).items() if p not in gone}
        paths = index._stored(index.current(), "paths", text_index.PATHS).collect()
        segments.add(len({r.segment for r in paths}))
        assert sorted(r.path for r in paths) == sorted(texts)
        blocks = {}
        for r in paths:
            blocks.setdefault((r.segment, r.block), []).append(r.doc)
        # numbers without gaps, and few blocks that are not half full
        assert all(sorted(b) == list(range(len(b))) and len(b) <= 8 for b in blocks.values())
        bodies = spark.createDataFrame(list(texts.items()), "path string, body string")
        want = [(r.path, r.score) for r in catalog.search(bodies, ["w1", "é", "w7"], 9).collect()]
        assert [tuple(r) for r in index.search(["W1", "é", "w7"], 9).rows.collect()] == want
        want = {}
        for b in texts.values():
            for w in set((b or "").lower().replace("-", " ").split()):
                want[w] = want.get(w, 0) + 1
        assert {r.term: r.df for r in index.frequencies().collect()} == want
    assert len(segments) > 1
    # nothing new but three documents: what was left of the blocks went together
    assert len(blocks) <= 4 * len(segments) + 2 * len(texts) / 4 + 3
    held = index._read(index.current(), "blocks", text_index.BLOCKS).where(F.col("term") == "é").collect()
    assert sorted(p.path for r in held for p in r.postings) == sorted(p for p, b in texts.items() if "É" in (b or ""))
    # no posting of a kept document is a row of its own, and nothing staged is left
    assert not any("explode(postings" in p for path, p in plans if "blocks/" in path)
    assert index.subfolders("staging") == []
