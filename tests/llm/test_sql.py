"""Queries of this subpackage against their SQL."""

import pytest
from oracle import differences

from tracemill.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows_as_sql(spark, name):
    assert differences(spark, queries.queries()[name], queries.oracle_sql()[name]) == []


def test_one_query_for_each_operator():
    assert [int(n[2:].split("_")[0]) for n in queries.queries()] == list(range(1, 14))
