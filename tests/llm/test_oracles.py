"""Every training-data query that SQL can express, against its SQL."""

import pytest

from conftest import SMALL
from logloom.llm.catalog import all_oracles, all_queries
from oracle_util import compare, duck


@pytest.mark.parametrize("name", sorted(all_oracles()))
def test_query_matches_oracle(spark, name):
    ok, msg = compare(spark, duck(SMALL), all_queries()[name], all_oracles()[name], SMALL)
    assert ok, msg
