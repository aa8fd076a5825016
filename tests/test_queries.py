"""The registered chart queries against DuckDB on the smallest tables, and the driver's contract."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from abacist.plans import queries as chart

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "null"
    return f"{value + 0.0:.6g}" if isinstance(value, float) else str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(chart.ORACLE_SQL))
def test_like_duckdb(spark, duck, name):
    if not os.path.isdir(SF):
        pytest.skip("no test data")
    found = chart.QUERIES[name](spark, SF)
    wanted = duck.sql(chart.ORACLE_SQL[name])
    assert sorted(found.columns) == sorted(wanted.columns)
    assert rows_of(found.columns, found.collect()) == rows_of(wanted.columns, wanted.fetchall())


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
