"""Queries against their SQL."""

import pytest
from oracle import connect, difference

from inkweave.llm import queries, sql
from inkweave.session import prepare


@pytest.mark.parametrize("name", sorted(sql.oracle_sql()))
def test_against_sql(spark, data, name):
    assert difference(prepare(spark), connect(data), queries.queries()[name], sql.oracle_sql()[name], data) is None
