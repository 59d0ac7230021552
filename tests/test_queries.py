"""Every registered query against its SQL, run by DuckDB on the same tables."""

import glob
import math
import os

import duckdb
import pytest

from tremora.plans.registry import ORACLES, QUERIES

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def plain(rows):
    return sorted(tuple("null" if v is None or (isinstance(v, float) and math.isnan(v)) else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    found = duck.sql(ORACLES[name])
    order = sorted(range(len(found.columns)), key=lambda i: found.columns[i])
    assert columns == [found.columns[i] for i in order]
    assert plain(df.select(*[f"`{c}`" for c in columns]).collect()) == plain([tuple(r[i] for i in order) for r in found.fetchall()])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_gives_rows(spark, name):
    assert QUERIES[name](spark, DATA).count() >= 1


def test_entry_module(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 1
    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
