"""Every query against its SQL on the test data."""

from __future__ import annotations

import pytest

import __spark_entry__ as contract
from checks.catalog import QUERIES
from checks.compare import difference, oracle_connection
from checks.oracles import ORACLES


@pytest.fixture(scope="module")
def con(sf_dir):
    return oracle_connection(sf_dir)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(contract.queries()) and set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, con, sf_dir, name):
    assert difference(spark, con, name, sf_dir) is None


def test_flagship_query(spark):
    assert contract.entry(spark).columns == ["position", "color", "user_count"]
    assert contract.entry(spark).count() == 5
