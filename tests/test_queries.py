"""Every registered query runs at the smallest scale and equals its SQL where there is one."""

import os

import pytest
from oracle import compare, connect

from raceframe.plans import all_queries

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
REGISTRY = all_queries()


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_every_sql_has_a_query():
    assert set(REGISTRY.ORACLES) <= set(REGISTRY.QUERIES)


@pytest.mark.parametrize("name", sorted(REGISTRY.QUERIES))
def test_query(spark, con, name):
    df = REGISTRY.QUERIES[name](spark, SF_DIR)
    if name in REGISTRY.ORACLES:
        assert compare(df, con, REGISTRY.ORACLES[name]) is None
    else:
        assert df.count() > 0
