"""Every core query runs; those with SQL equal DuckDB."""

import pytest

from dossierflow.plans import queries as core

from .sqlcheck import assert_equal

QUERIES, SQL = core.queries(), core.oracle_sql()


def test_every_sql_has_its_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_duckdb(spark, data, name):
    assert_equal(spark, data, QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs_twice_alike(spark, data, name):
    rows = lambda: sorted(map(repr, QUERIES[name](spark, data).collect()))
    assert rows() == rows()
