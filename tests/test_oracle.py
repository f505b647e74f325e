"""Every registered query against its DuckDB oracle on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from logloom.plans.catalog import all_queries
from oracle_util import compare, duck

SF = os.environ.get("LOGLOOM_TEST_SF", "/root/testdata/sf0.001")
QUERIES = {k: v for k, v in entry.queries().items() if k in all_queries()}
ORACLES = {k: v for k, v in entry.oracle_sql().items() if k in QUERIES}


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    ok, msg = compare(spark, con, QUERIES[name], ORACLES[name], SF)
    assert ok, msg


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert df.columns == ["run_key", "merge_rank", "line_no", "text"]
