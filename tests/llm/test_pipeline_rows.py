"""Pipeline stages on the rows that a corpus may hold."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from test_llm_operators import BASE, CLASH

SF = "/root/testdata/sf0.001"
ROWS = [
    (1, BASE, "s"), (2, BASE, "s"), (2, BASE, "s"), (3, BASE + " tail", None), (4, None, "s"), (5, "", "s"), (6, " \n ", "t"),
    (7, "one two", "t"), (None, BASE, "s"), (None, None, "s"), (8, "one two", "t"), (8, "other", "t"), (9, "é " * 30_000 + BASE, "u"),
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "en", s, None if t is None else len(t), *("x",) * len(CLASH)) for i, t, s in ROWS]
    kinds = ", ".join(f"`{c}` string" for c in CLASH if c not in ("n",))
    extra = [c for c in CLASH if c not in ("n",)]
    return spark.createDataFrame([r[: 5 + len(extra)] for r in rows], f"doc_id bigint, text string, lang string, source string, n_chars bigint, {kinds}")


def _ids(df):
    return sorted(((-1 if r.doc_id is None else r.doc_id) for r in df.collect()))


def test_stages_on_odd_rows(spark, odd):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, odd, SF)
        assert out.columns == odd.columns, name
        assert {tuple(r) for r in out.select("n_chars").where("text is null").collect()} <= {(None,)}
        empty = stage(spark, odd.limit(0), SF)
        assert empty.columns == odd.columns and empty.count() == 0, name
    exact = corpus_pipeline.exact_stage(spark, odd, SF)
    # BASE: 2; null and empty texts: 5; of documents 7 and 8 the larger id
    assert _ids(exact) == [2, 3, 5, 6, 8, 8, 9]
    near = corpus_pipeline.near_stage(spark, odd, SF)
    # 2, 3 and 9 resemble 1, one text of 8 is that of 7
    assert _ids(near) == [-1, -1, 1, 4, 5, 6, 7]
    cut = corpus_pipeline.substring_stage(spark, odd, SF)
    assert _ids(cut) == _ids(odd)
    texts = {(r.doc_id, r.text) for r in cut.collect() if r.doc_id not in (8, None)}
    assert (1, BASE) in texts and (2, "") in texts and (3, "tail") in texts and (4, None) in texts and (6, " \n ") in texts
    packed = corpus_pipeline.packing_stage(spark, odd, SF)
    assert packed.agg(F.countDistinct("doc_id")).first()[0] == 9 and packed.where("doc_id = 4").count() == 1
    assert corpus_pipeline.packing_stage(spark, odd.limit(0), SF).count() == 0
