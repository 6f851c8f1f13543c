"""The SQL of the corpus queries against the queries, on the smallest tables."""

import os

import pytest

from tessera.llm import entries

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
@pytest.mark.parametrize("name", entries.oracle_sql())
def test_query_equals_sql(spark, name):
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "embeddings"):
        c.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    want = c.execute(entries.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    got = entries.queries()[name](spark, SF)
    assert sorted(columns) == sorted(got.columns)
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(want.fetchall())


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
@pytest.mark.parametrize("name", ["op1_language_id", "op2_main_text", "op4_license_scan", "op6_pack", "op8_quality"])
def test_rows_of_whole_tables(spark, name):
    table, key = ("pages", "page_id") if name == "op2_main_text" else ("documents", "doc_id")
    want = {r[0] for r in spark.read.parquet(f"{SF}/{table}.parquet").select(key).collect()}
    got = [r[0] for r in entries.queries()[name](spark, SF).select(key).collect()]
    if name == "op1_language_id":  # pages too, without a doc_id
        assert got.count(None) == spark.read.parquet(f"{SF}/pages.parquet").count()
        got = [i for i in got if i is not None]
    assert set(got) == want and (name == "op6_pack" or len(got) == len(want))
