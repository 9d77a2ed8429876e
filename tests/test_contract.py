"""The library's queries against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from tarn import catalogue

DATA = os.environ.get("TARN_TEST_DATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{DATA}/{name}'")
    return con


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", catalogue.QUERIES)
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, DATA)
    rel = duck.sql(catalogue.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(rel.columns)
    columns = sorted(df.columns)
    order = [rel.columns.index(c) for c in columns]
    assert sorted(tuple(map(str, (r[c] for c in columns))) for r in df.collect()) == sorted(tuple(str(r[i]) for i in order) for r in rel.fetchall())


def test_entry_points():
    import __spark_entry__

    assert set(catalogue.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
