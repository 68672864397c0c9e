import pytest

from driftloom.llm.queries import ORACLES, QUERIES
from tests.compare import difference


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_rows_equal_the_sql(spark, name):
    assert difference(spark, "/root/testdata/sf0.001", QUERIES[name], ORACLES[name]) is None


def test_one_query_each():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
