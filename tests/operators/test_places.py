import random

import pytest
from pyspark.sql import functions as F

from driftloom.operators import places

AT = {"low": lambda n: n * 0, "p25": lambda n: F.floor(n / 4), "p90": lambda n: F.floor((n - 1) * 0.9), "high": lambda n: n - 1}


def exact(rows):
    by = {}
    for g, v in rows:
        if v is not None and v == v:
            by.setdefault(g, []).append(v)
    out = {}
    for g, vs in by.items():
        vs.sort()
        n = len(vs)
        out[g] = (n, vs[0], vs[n // 4], vs[int((n - 1) * 0.9)], vs[-1])
    return out


def rows(seed=4):
    rng = random.Random(seed)
    out = [("spread", rng.random()) for _ in range(3000)] + [("outlier", rng.random()) for _ in range(3000)] + [("outlier", 1e12)]
    out += [("equal", 5.0)] * 900 + [("equal", float(i)) for i in range(100)] + [("few", 1.0), ("few", -2.0), ("one", 7.0)]
    out += [("wide", rng.choice([-1, 1]) * 10 ** rng.uniform(-300, 300)) for _ in range(2000)] + [("wide", float("inf")), ("wide", float("-inf"))]
    return out + [("none", None), ("none", float("nan")), ("spread", None), (None, 3.0), (None, 1.0)]


@pytest.mark.parametrize("most", [100_000, 500, 40, 2])
def test_places_are_exact_whatever_is_sorted_at_once(spark, most):
    own = rows()
    frame = spark.createDataFrame(own, "g string, v double").repartition(4)
    got = {r.g: tuple(r)[1:] for r in places.values_at(frame, "v", ("g",), AT, most).collect()}
    assert got == exact(own)


def test_a_sketch_that_is_wrong_costs_a_round_only(spark, monkeypatch):
    own = rows(5)
    frame = spark.createDataFrame(own, "g string, v double")
    real = F.percentile_approx
    for answer in (0.5, -1e300, 1e300):  # all shares at one value: every place lies outside
        monkeypatch.setattr(F, "percentile_approx", lambda v, q, a, x=answer: F.transform(q, lambda _: F.lit(x)) if v == "v" and not done.pop() else real(v, q, a))
        done = [True] * 50 + [False]
        got = {r.g: tuple(r)[1:] for r in places.values_at(frame, "v", ("g",), AT, 2000).collect()}
        assert got == exact(own)


def test_no_task_has_most_of_the_values_of_a_group_with_an_outlier(spark, monkeypatch):
    sizes = []
    real = places._chosen

    def seen(frame):
        sizes.append(frame.groupBy("g", "name").count().agg(F.max("count")).first()[0])
        return real(frame)

    monkeypatch.setattr(places, "_chosen", seen)
    frame = spark.range(20_000).select(F.lit(1).alias("g"), F.when(F.col("id") == 0, 1e12).otherwise(F.col("id") / 1e6).alias("v"))
    got = places.values_at(frame, "v", ("g",), AT, 300).first()
    assert (got.low, got.p25, got.high) == (1e-6, 0.005001, 1e12) and sizes[0] <= 600


def test_percentiles_and_nothing(spark):
    frame = spark.createDataFrame([(float(i),) for i in range(5)], "v double")
    assert places.percentile(frame, "v", 0.9).first().value == pytest.approx(3.6)
    assert places.percentile(frame.where("v > 9"), "v", 0.9).collect() == []
