"""Every named query against its SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from parlance.plans.registry import ORACLE, QUERIES
from tools.check import TABLES, compare


@pytest.fixture(scope="module")
def con(sf):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf}/{table}.parquet')")
    return con


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(ORACLE)


def test_entry_names_every_query():
    assert set(QUERIES) <= set(entry.queries())
    assert set(ORACLE) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, sf, name):
    state, rows, _, _, note = compare(spark, con, name, QUERIES[name], ORACLE[name], sf)
    assert state == "ok", note


def test_entry(spark):
    assert entry.entry(spark).count() > 0
