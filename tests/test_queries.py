"""Every registered query against its SQL in DuckDB, and twice for the same result."""

import os

import pytest

import __spark_entry__ as entry
from estatescope.star import all_queries, all_sql
from compare import bag, connect, difference

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, SQL = all_queries(), all_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, duck, name):
    assert difference(QUERIES[name](spark, SF), duck, SQL[name]) is None


@pytest.mark.parametrize("name", ["first_match", "load_jobs", "report_routines", "top_10_per_group"])
def test_two_runs_agree(spark, name):
    first, second = (QUERIES[name](spark, SF) for _ in range(2))
    assert bag(first.columns, first.collect()) == bag(second.columns, second.collect())


def test_flagship(spark):
    assert entry.entry(spark).count() == 25
