"""Every registered query with SQL gives the same rows as that SQL; the others give rows."""

import pytest

import __spark_entry__ as entry
from tests.oracle_check import compare, connect

FOLDER = "/root/testdata/sf0.001"
# The same work as venue_resolution or suspect_priorities.
SLOW = {"venue_ranking", "venue_stage_counts", "rank_distribution", "quartile_losses", "suspect_priority_counts"}
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, con, name):
    assert compare(QUERIES[name](spark, FOLDER), con, SQL[name]) == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL) - SLOW))
def test_gives_rows(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0


def test_sql_belongs_to_queries():
    assert set(SQL) <= set(QUERIES)
