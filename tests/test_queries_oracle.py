"""Every registered query with a SQL twin equals DuckDB on the smoke tables;
the entry point runs; every SQL twin belongs to a registered query."""

import pytest

import __spark_entry__ as E
from conftest import SMOKE
from oracle_harness import compare

SQL = E.oracle_sql()
SLOW: set[str] = set()


def test_entry(spark):
    df = E.entry(spark)
    assert df.count() > 0 and "n" in df.columns


def test_every_twin_is_registered():
    assert set(SQL) <= set(E.queries())


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_duckdb(spark, name):
    problems, _ = compare(spark, name, E.queries()[name], SQL[name], SMOKE)
    assert not problems, problems


@pytest.mark.parametrize("name", sorted(set(E.queries()) - set(SQL) - SLOW))
def test_rows_only_queries_run(spark, name):
    assert E.queries()[name](spark, SMOKE).count() > 0
