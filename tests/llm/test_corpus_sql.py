"""The queries that SQL can express, on small tables."""

import pytest
from oracle import compare

from panelloom.llm.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, name):
    assert compare(spark, "/root/testdata/sf0.001", QUERIES[name], SQL[name]) == 200
