"""Every query against its SQL, and those without SQL for rows and a stable schema."""

import pytest
from oracle import connect, difference

from inkweave.plans import catalog
from inkweave.session import prepare

SQL = catalog.oracle_sql()
#: Tested against brute force by themselves.
ELSEWHERE = {n for n in catalog.queries() if n.startswith("p")} & {n for n in catalog.queries() if n[1:2].isdigit()}


@pytest.fixture(scope="module")
def con(data):
    return connect(data)


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, data, con, name):
    assert difference(prepare(spark), con, catalog.queries()[name], SQL[name], data) is None


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(SQL) - ELSEWHERE))
def test_rows(spark, data, name):
    assert catalog.queries()[name](prepare(spark), data).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert {r.status for r in entry.entry(spark).collect()} <= {"accepted", "rejected", "deferred"}
    assert set(entry.oracle_sql()) <= set(entry.queries())
