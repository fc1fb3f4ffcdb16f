"""The queries that have SQL, next to it in DuckDB."""

from __future__ import annotations

import pytest

from checks.compare import oracle_connection, tidy
from muralog.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, sf_dir, name):
    ours = QUERIES[name](spark, sf_dir).toPandas()
    theirs = oracle_connection(sf_dir).execute(ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns) and len(ours) == len(theirs) > 0
    assert (tidy(ours) == tidy(theirs)).all(axis=None)
