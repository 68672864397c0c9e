"""What kind of failure a run shows: four rule scores, and which are reported."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Settings
from ..functions.vectors import clip, ratio

#: In the order of rules, which decides between equals.
TYPES = ("retrieval", "inference", "context_poisoning", "confidence_inflation")


def rule_columns(signals: DataFrame, settings: Settings = Settings(), nli: bool = True) -> DataFrame:
    """``signals`` with what each step adds to the rules.

    Only steps with an anchor drift count; the window puts them first, so rank
    and lag are among them.  All windows are partitioned by run.
    """
    t, tau = settings.profile.drift_threshold, settings.profile.entail_threshold
    measured = F.col("drift_anchor").isNotNull()
    w = Window.partitionBy("run_id").orderBy(F.col("drift_anchor").isNull(), "ordinal")
    role_last = F.last("role").over(Window.partitionBy("run_id", "step_id").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    rows = signals.withColumn("_role", role_last).withColumn("_rank", F.row_number().over(w)).withColumn("_before", F.lag("drift_anchor").over(w))
    jump = F.col("drift_anchor") - F.col("_before")
    outside = F.coalesce(F.lower("_role").isin(*settings.external_roles), F.lit(False))
    base = clip(ratio(jump, F.lit(max(2 * t, 1e-9))))
    jumped = F.when(jump > 0, F.when(outside, clip(base * 1.5)).otherwise(base))
    violation = clip(ratio(F.lit(tau) - F.col("entailment"), F.lit(float(tau)))) if nli and tau else F.lit(None).cast("double")
    bad = F.when(measured & F.col("conclusive") & F.col("entailment").isNotNull() & (violation > 0), F.struct(violation.alias("v"), (-F.col("ordinal")).alias("back"), "step_id"))
    leap = F.when(measured & (jumped > 0), F.struct(jumped.alias("v"), (-F.col("ordinal")).alias("back"), "step_id", outside.alias("outside")))
    return rows.withColumn("_bad", bad).withColumn("_leap", leap)


def rule_aggregates() -> list[Column]:
    """What the rules need of each run: one aggregation over ``rule_columns``.

    Retrieval rests on the mean of the first two anchor drifts, inference on
    the worst conclusive step and the share of rising transitions, poisoning on
    the largest jump (the first of equals), inflation on the sum of certainty's rises.
    """
    measured = F.col("drift_anchor").isNotNull()
    only = lambda c: F.when(measured, F.col(c))
    return [
        F.avg(F.when(F.col("_rank") <= 2, F.col("drift_anchor"))).alias("early"),
        F.count_if(measured).alias("n"),
        F.count_if(F.col("drift_anchor") > F.col("_before")).alias("rises"),
        F.max("_bad").alias("bad"), F.max("_leap").alias("leap"),
        F.bool_or(only("conclusive")).alias("any_conclusive"), F.sum(only("certainty_delta")).alias("inflation"),
        F.min_by("drift_anchor", F.when(measured, F.col("ordinal"))).alias("first"), F.max_by("drift_anchor", F.when(measured, F.col("ordinal"))).alias("last"),
        F.bool_or(only("flagged")).alias("any_flagged"),
    ]


def scored(runs: DataFrame, settings: Settings = Settings(), nli: bool = True) -> DataFrame:
    """``runs`` of rule_aggregates with the four scores and their rationales; null where nothing was measured."""
    t = settings.profile.drift_threshold
    rising = F.when(F.col("n") > 1, F.col("rises") / (F.col("n") - 1)).otherwise(F.lit(0.0))
    rises_up = (F.col("n") > 1) & (F.col("last") > F.col("first"))
    if nli:
        inference = clip(0.7 * F.coalesce(F.col("bad.v"), F.lit(0.0)) + 0.3 * rising)
        why = F.when(F.col("bad").isNotNull(), F.format_string("conclusive claim at step %s under-entailed by its premise", "bad.step_id")).otherwise(F.format_string("no entailment violation on conclusive claims; anchor rising %.0f%%", 100 * rising))
    else:
        inference = clip(rising * F.when(F.col("any_conclusive"), 0.7).otherwise(0.4))
        why = F.format_string("drift-only mode: anchor drift rising (%.0f%% of transitions)", 100 * rising)
    poisoned = F.when(F.col("leap").isNull(), F.lit("no sudden mid-chain drift jump")).otherwise(F.concat(F.format_string("sudden anchor-drift jump at step %s", "leap.step_id"), F.when(F.col("leap.outside"), " on externally-sourced content").otherwise("")))
    rationales = F.array(
        F.format_string(f"anchor drift high from the first steps (mean %.3f vs threshold {t})", "early"), why, poisoned,
        F.format_string("certainty language strengthened (total inflation %.2f, anchor drift %s)", "inflation", F.when(rises_up, "rising").otherwise("flat")),
    )
    any_measured = F.col("n") > 0
    values = {
        "retrieval": clip(ratio(F.col("early") - t, F.lit(max(2 * t, 1e-9)))),
        "inference": inference,
        "context_poisoning": F.coalesce("leap.v", F.lit(0.0)),
        "confidence_inflation": clip(clip(F.col("inflation")) * F.when(rises_up, 1.0).otherwise(0.5)),
    }
    return runs.select("*", *[F.when(any_measured, v).alias(k) for k, v in values.items()], F.when(any_measured, rationales).alias("rationales"))


def rule_scores(signals: DataFrame, settings: Settings = Settings(), nli: bool = True) -> DataFrame:
    """run_id, flagged, the four scores and rationales of each run with a measured step."""
    runs = rule_columns(signals, settings, nli).groupBy("run_id").agg(*rule_aggregates()).where("n > 0")
    return scored(runs, settings, nli).select("run_id", F.col("any_flagged").alias("flagged"), *TYPES, "rationales")


def chosen(cutoff: float, flagged: str = "flagged") -> Column:
    """Types from the cutoff on, largest first, equals in the order of rules.

    If there is none and a measured step is flagged, the best type above 0.
    """
    each = F.array(*[F.struct((-F.col(k)).alias("minus"), F.lit(i).alias("rule"), F.lit(k).alias("cascade_type"), F.get("rationales", i).alias("rationale")) for i, k in enumerate(TYPES)])
    ranked = F.array_sort(each)
    above = F.filter(ranked, lambda s: -s["minus"] >= cutoff)
    best = F.filter(F.slice(ranked, 1, 1), lambda s: -s["minus"] > 0)
    some = F.when(F.size(above) > 0, above).when(F.col(flagged), best).otherwise(F.slice(ranked, 1, 0))
    return F.transform(some, lambda s: F.struct(s["cascade_type"].alias("cascade_type"), (-s["minus"]).alias("confidence"), s["rationale"].alias("rationale")))


def classification(scores: DataFrame, cutoff: float) -> DataFrame:
    """run_id, classification of rule_scores."""
    return scores.select("run_id", chosen(cutoff).alias("classification"))
