"""Registered queries against their SQL on the smallest tables."""

import os

import pytest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


def names():
    from tessera.queries import SQL

    return [n for n in SQL if not n.startswith("factor_")] + ["factor_momentum", "factor_quality_pa"]


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events".split():
        c.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


def plain(rows):
    return sorted(tuple(round(v, 4) if isinstance(v, float) else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", names())
def test_query_equals_sql(spark, duck, name):
    from tessera.queries import QUERIES, SQL

    got = QUERIES[name](spark, SF)
    want = duck.execute(SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    a = plain(got.select(*columns).collect())
    b = plain(want.fetchall())
    assert len(a) == len(b)
    assert a == b


def test_entry(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.count() > 0 and "factor_trend_ma_20d" in df.columns
    assert set(e.oracle_sql()) <= set(e.queries())
