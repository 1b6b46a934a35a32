"""Every query of the catalog against its SQL on the small tables."""

import pytest
from oracle import connect, of_spark, of_sql

from ordinata.plans import catalog

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


def test_each_query_has_sql():
    assert QUERIES.keys() == SQL.keys()


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, small, name):
    got, want = of_spark(QUERIES[name](spark, small)), of_sql(con, SQL[name])
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    assert got[1] == want[1]
