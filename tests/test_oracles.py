"""Every panel query with SQL against DuckDB, on the smallest tables."""

import pytest
from oracle import compare

from panelloom.plans.oracles import SQL
from panelloom.plans.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, name):
    assert compare(spark, FOLDER, QUERIES[name], SQL[name]) > 0


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL) - {"discovery_entity", "discovery_forward", "adjustment_audit"}))
def test_rows(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0
