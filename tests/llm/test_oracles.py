import pytest
from oracle import connect, of_spark, of_sql

from ordinata.llm import queries


@pytest.mark.parametrize("name", list(queries.oracle_sql()))
@pytest.mark.parametrize("sf_dir", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_query_against_sql(spark, name, sf_dir):
    got, want = of_spark(queries.queries()[name](spark, sf_dir)), of_sql(connect(sf_dir), queries.oracle_sql()[name])
    assert got[0] == want[0] and len(got[1]) > 0
    assert got[1] == want[1]
