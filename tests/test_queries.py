"""Every registered query with SQL against DuckDB on the smallest tables; the others must run and keep their schema."""

import math

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
OWN = [n for n in entry.queries() if not n.startswith("op") and n != "pipeline"]


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def cell(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    return v if v is None or isinstance(v, (int, bool)) else str(v)


@pytest.mark.parametrize("name", OWN)
def test_query(spark, sf, duck, name):
    df = entry.queries()[name](spark, sf)
    columns = sorted(df.columns)
    rows = sorted((tuple(cell(r[c]) for c in columns) for r in df.collect()), key=repr)
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert rows and len(set(columns)) == len(columns)
        return
    found = duck.sql(sql)
    assert sorted(found.columns) == columns
    at = [found.columns.index(c) for c in columns]
    assert rows == sorted((tuple(cell(r[i]) for i in at) for r in found.fetchall()), key=repr)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
