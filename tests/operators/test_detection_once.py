"""Errors of all kinds are made and judged once."""

from pyspark.sql import functions as F

from driftloom.operators import inject
from driftloom.operators.steps import dealt
from driftloom.plans import wider
from tests.operators.test_signals import steps


def test_each_kind_is_as_injected_alone(spark):
    own = steps(spark, ["Some may 12 go", "Then Mary saw 3.5 of it", "So it might be", None, "the 7 end"]).unionByName(steps(spark, ["too", "short"], run="t"))
    changed, records = inject.inject_each(own, seed=4)
    rows = lambda df: sorted(map(str, df.collect()))
    named = lambda df, kind: df.withColumn("run_id", F.concat("run_id", F.lit(f"--{kind}")))
    for kind in inject.KINDS:
        one, told = inject.inject(own, kind, 4)
        assert rows(named(one, kind)) == rows(changed.where(F.col("run_id").endswith(kind))) and rows(named(told, kind)) == rows(records.where(F.col("kind") == kind))


def test_signals_of_all_kinds_are_made_once(spark):
    plan = wider.detection_by_kind(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") <= 3  # the judged texts, their bags, the records
    assert dealt(steps(spark, ["a", "b"]), 100 << 22).rdd.getNumPartitions() == 100
