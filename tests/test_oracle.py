"""Every registered query against DuckDB on the smallest tables."""

import pytest

import __spark_entry__ as entry
from compare import connection, difference

FOLDER = "/root/testdata/sf0.001"
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connection(FOLDER)


def test_every_statement_belongs_to_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_agrees_with_sql(spark, con, name):
    assert difference(QUERIES[name](spark, FOLDER), con, SQL[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, FOLDER).limit(1).count() >= 0


def test_entry_runs(spark):
    rows = entry.entry(spark).collect()
    assert {r["column"] for r in rows} >= {"l_orderkey", "l_shipdate"}
