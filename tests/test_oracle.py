"""Every registered query against its SQL at the smallest scale."""

import pytest

import __spark_entry__ as entry
import oracle

SF = "/root/testdata/sf0.001"
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    ok, note = oracle.compare(spark, duck, name, QUERIES[name], SQL.get(name), SF)
    assert ok, note


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
    assert set(SQL) <= set(QUERIES)


def test_content_hash_of_every_document(spark):
    found = QUERIES["P10_content_hash_all"](spark, SF)
    assert found.select("doc_id").distinct().count() == spark.read.parquet(f"{SF}/documents.parquet").count()
