"""Every query equals its SQL twin on the given tables."""

import pytest

import __spark_entry__ as contract
from compare import assert_same, duckdb_over
from staycohort import REPORTS
from staycohort.checks import OPERATOR_QUERIES

QUERIES, ORACLES = contract.queries(), contract.oracle_sql()


@pytest.fixture(scope="module", params=["sf0.001", "sf0.01"])
def dataset(request):
    sf_dir = f"/root/testdata/{request.param}"
    return sf_dir, duckdb_over(sf_dir)


def test_every_query_has_an_oracle():
    assert {*REPORTS, *OPERATOR_QUERIES} <= ORACLES.keys() <= QUERIES.keys()


@pytest.mark.parametrize("key", ORACLES)
def test_query_equals_oracle(spark, dataset, key):
    sf_dir, connection = dataset
    assert_same(QUERIES[key](spark, sf_dir), connection, ORACLES[key])
