"""Every registered query at the smallest scale, against its DuckDB text where it has one."""

import pytest

from aisle import plans
from tests.oracle import compare, connect

DIRECTORY = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(DIRECTORY)


@pytest.mark.parametrize("name", list(plans.queries()))
def test_query(spark, con, name):
    status, note = compare(spark, con, DIRECTORY, name)
    assert status in ("ok", "rows-only"), note


def test_oracles_belong_to_queries():
    assert set(plans.oracle_sql()) <= set(plans.queries())
