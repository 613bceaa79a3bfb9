import pytest

from lattica.llm import contract
from tests.oracle import same


@pytest.mark.parametrize("name", sorted(contract.oracle_sql()))
def test_query_equals_sql(spark, name):
    assert same(spark, "/root/testdata/sf0.001", contract.queries()[name], contract.oracle_sql()[name])


def test_ten_queries():
    assert sorted(n.split("_")[0] for n in contract.queries()) == sorted(f"op{k}" for k in range(1, 11))
