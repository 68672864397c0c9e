import pytest

import __spark_entry__ as entry
from driftloom.plans.oracle import SQL
from driftloom.plans.queries import QUERIES
from tests.compare import difference

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_rows_equal_the_sql(spark, name):
    assert difference(spark, SMALL, QUERIES[name], SQL[name]) is None


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


def test_omission_and_reasons_occur(spark):
    """Comparisons that hold rows against rows, not nothing against nothing."""
    told = QUERIES["omission_signals"](spark, SMALL).collect()
    assert any("omission" in r.codes for r in told) and len({r.coverage for r in told}) > 2
    assert any("anchor-fact coverage" in r.reasons for r in QUERIES["flag_reasons"](spark, SMALL).collect())
    assert QUERIES["truncated_steps"](spark, SMALL).count() > 0
