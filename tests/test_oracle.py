"""Every query of the suite beside its SQL, over whole tables."""

import pytest

import __spark_entry__ as contract
from rillwork.suite import ORACLES, QUERIES
from tools.check import compare, connect

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(contract.queries()) and set(ORACLES) <= set(contract.oracle_sql())


def test_entry(spark):
    assert contract.entry(spark).count() == 6


@pytest.mark.parametrize("key", list(QUERIES))
def test_same_as_sql(spark, con, key):
    verdict, _ = compare(spark, con, key, SF_DIR, QUERIES, ORACLES)
    assert verdict.startswith("ok"), verdict
