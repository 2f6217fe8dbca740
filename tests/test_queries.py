"""Every query with SQL against DuckDB on the smallest tables; the rest must run and keep their schema."""

import os
from collections import Counter

import pytest

import __spark_entry__ as entry

duckdb = pytest.importorskip("duckdb")
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def views(data):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in os.listdir(data):
        con.execute(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{data}/{t}'")
    return con


def plain(v):
    if isinstance(v, float):
        return repr(round(v, 6))
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    return str(v)


def test_sql_only_for_queries():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, views, name):
    df = QUERIES[name](spark, data)
    columns = sorted(df.columns)
    got = Counter(tuple(plain(r[c]) for c in columns) for r in df.collect())
    if name in SQL:
        cursor = views.execute(SQL[name])
        names = [d[0] for d in cursor.description]
        assert sorted(names) == columns
        at = [names.index(c) for c in columns]
        assert got == Counter(tuple(plain(r[i]) for i in at) for r in cursor.fetchall())


def test_entry(spark):
    assert entry.entry(spark).columns
