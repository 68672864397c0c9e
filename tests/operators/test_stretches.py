import random

import pytest
from pyspark.sql import functions as F

from driftloom.config import Profile, Settings
from driftloom.operators import attribute, classify, evaluate, signals, stretches, verdict
from driftloom.operators.steps import densified

KIND = "run_id string, pos int, step_id string, agent_name string, role string, text string"


def steps_of(spark):
    rng = random.Random(6)
    words = "we measured the rate of 5 percent which may be clearly proven therefore it is certain that growth was low".split()
    rows = []
    for run, n in (("long", 700), ("a", 1), ("b", 2), ("c", 33), ("d\u0000e", 5), ("", 3)):
        for p in range(n):
            text = " ".join(rng.choice(words) for _ in range(rng.randint(1, 12))) if rng.random() > 0.05 else rng.choice(["", None, " "])
            rows.append((run, p * 3, str(rng.choice([p, p // 2])), "x", rng.choice(["tool", "user", None]), text))
    rng.shuffle(rows)
    return spark.createDataFrame(rows, KIND).repartition(5)


SETTINGS = Settings(profile=Profile(name="t", drift_threshold=0.7, entail_threshold=0.3, aggregate_threshold=0.5))


def told(frame):
    def near(x):
        return round(x, 9) + 0.0 if isinstance(x, float) else tuple(map(near, x)) if isinstance(x, (list, tuple)) else x

    return sorted((repr(tuple(near(v) for v in r)) for r in frame.select(*sorted(frame.columns)).collect()))


def test_numbers_by_parts_are_those_by_run(spark):
    steps = steps_of(spark)
    assert told(stretches.numbered(steps)) == told(densified(steps))
    assert stretches.numbered(steps.where("false")).collect() == []


@pytest.mark.parametrize("size", [1, 2, 64, 5000])
def test_stretches_give_the_rows_of_whole_runs(spark, size):
    own = densified(steps_of(spark)).cache()
    anchors = spark.createDataFrame([("long", "text", ["growth was low. The rate was 5 percent in all of it."]), ("b", "list", ["it is certain", "we measured"])], "run_id string, kind string, texts array<string>")
    for given in (None, anchors):
        want = signals.signals(own, SETTINGS, given)
        assert told(stretches.long_signals(own, SETTINGS, given, size=size)) == told(want)
    want = signals.signals(own, SETTINGS).cache()
    assert told(stretches.long_rule_scores(want, SETTINGS, size=size)) == told(classify.rule_scores(want, SETTINGS))
    assert told(stretches.long_candidates(want, SETTINGS)) == told(attribute.candidates(want, SETTINGS))
    assert told(stretches.long_consecutive(want, size)) == told(evaluate.consecutive_flags(want))
    assert told(verdict.verdicts(stretches.long_signals(own, SETTINGS, size=size), SETTINGS.profile)) == told(verdict.verdicts(want, SETTINGS.profile))
    own.unpersist()
    want.unpersist()


def test_steps_that_were_not_measured_are_skipped_over(spark):
    """A stretch may have no measured step at all: what came before is carried over it."""
    own = signals.signals(densified(steps_of(spark)), SETTINGS)
    holes = own.withColumn("drift_anchor", F.when(~F.col("ordinal").between(10, 40) & (F.col("ordinal") % 3 > 0), F.col("drift_anchor"))).cache()
    assert told(stretches.long_rule_scores(holes, SETTINGS, size=8)) == told(classify.rule_scores(holes, SETTINGS))
    holes.unpersist()
