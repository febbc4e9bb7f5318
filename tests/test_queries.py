"""Every registered query with SQL equals DuckDB on the smallest tables; the others return rows."""

from __future__ import annotations

import pytest
from oracle import connection, same

from ragframe.plans import registry


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connection(sf_dir)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, sf_dir, duck, name):
    df = registry.queries()[name](spark, sf_dir)
    sql = registry.oracle_sql().get(name)
    if sql:
        same(df, duck, sql)
    else:
        assert df.count() > 0


def test_inputs_read_all_documents(spark, tmp_path):
    from ragframe.plans import ingest_queries, inputs

    docs = [(i, f"text {i}", "en", "s", 8) for i in (1, 70, 250, 900)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert {r["chunk_id"] // 1_000_000 for r in inputs.chunks(spark, str(tmp_path)).collect()} == {1, 70, 250, 900}
    assert ingest_queries._included(spark, str(tmp_path)).count() == 4


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries()) and set(registry.queries()) <= set(e.queries())
