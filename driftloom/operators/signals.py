"""All signals of each step, merged into one row, with flags and their reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Settings
from ..functions.text import certainty, facts, listed_facts, word_set
from ..functions.vectors import clip, weighted_mean
from .drift import bag_drift
from .scorers import overlap
from .steps import by_run


def entailment(steps: DataFrame) -> DataFrame:
    """run_id, ordinal, entailment, neutral, contradiction of each step by the one before."""
    own = steps.withColumn("w", word_set(F.col("text")))
    judged = own.withColumn("e", overlap(F.lag("w").over(by_run()), F.col("w")))
    return judged.select("run_id", "ordinal", "e.entailment", "e.neutral", "e.contradiction")


def certainties(steps: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """run_id, ordinal, score, hits, conclusive, and certainty_delta: the rise since the step before, 0 for the first."""
    own = steps.select("run_id", "ordinal", certainty(F.col("text"), settings.lexicon).alias("c")).select("run_id", "ordinal", "c.*")
    return own.withColumn("certainty_delta", F.coalesce(clip(F.col("score") - F.lag("score").over(by_run())), F.lit(0.0)))


def anchor_facts(anchors: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """run_id, facts of (run_id, kind, texts): a text is split, a list passes as it is; runs without facts are left out."""
    split = F.when(F.col("kind") == "list", listed_facts(F.col("texts"), settings.max_facts)).otherwise(facts(F.get("texts", 0), settings.max_facts, settings.min_fact_chars))
    return anchors.select("run_id", split.alias("facts")).where("size(facts) > 0")


def coverage(steps: DataFrame, facts_by_run: DataFrame, threshold: float) -> DataFrame:
    """run_id, ordinal, coverage, omission: the share of facts that a step entails, and its loss since the step before.

    The first step is held against full coverage.  Facts are few a run, so
    they come by one equi-join and are judged inside the row.
    """
    sets = facts_by_run.select("run_id", F.transform("facts", lambda f: word_set(f)).alias("facts"))
    own = steps.select("run_id", "ordinal", word_set(F.col("text")).alias("w")).join(sets, "run_id")
    held = F.filter("facts", lambda f: overlap(F.col("w"), f)["entailment"] >= threshold)
    own = own.select("run_id", "ordinal", (F.size(held) / F.size("facts")).alias("coverage"))
    return own.withColumn("omission", F.greatest(F.lit(0.0), F.lag("coverage", 1, 1.0).over(by_run()) - F.col("coverage")))


def aggregate_score(settings: Settings) -> Column:
    """Weighted mean of drift, lack of entailment and rise of certainty, of those that are there."""
    some = F.col("drift_prev").isNotNull() | F.col("drift_anchor").isNotNull()
    w = settings.weights
    return weighted_mean(
        (F.when(some, F.col("combined_drift")), w.drift),
        (1 - F.col("entailment"), w.entailment),
        (F.when(F.col("ordinal") > 0, F.col("certainty_delta")), w.confidence),
    )


def flag_codes(settings: Settings) -> Column:
    """Codes of the flags, in the order of the reasons."""
    return F.transform(_flags(settings), lambda f: f["code"])


def _flags(settings: Settings) -> Column:
    p = settings.profile

    def one(code: str, fires: Column, reason: Column) -> Column:
        return F.when(fires, F.struct(F.lit(code).alias("code"), reason.alias("reason")))

    over = lambda c, level: one(c, F.col(c) > level, F.format_string(f"{c} %.3f > threshold {level}", c))
    return F.array_compact(
        F.array(
            over("drift_prev", p.drift_threshold),
            over("drift_anchor", p.drift_threshold),
            one("entailment", F.col("entailment") < p.entail_threshold, F.format_string(f"entailment %.3f < threshold {p.entail_threshold}", "entailment")),
            over("aggregate", p.aggregate_threshold),
            one("omission", F.col("omission") > p.omission_threshold, F.format_string(f"omission %.3f > threshold {p.omission_threshold} (anchor-fact coverage %.2f)", "omission", "coverage")),
        )
    )


def signals(steps: DataFrame, settings: Settings = Settings(), anchors: DataFrame | None = None, nli: bool = True, buckets: int | None = 128, drift: DataFrame | None = None, judged: DataFrame | None = None, covered: DataFrame | None = None, dealt: bool = False) -> DataFrame:
    """The signal row of each densified step.

    ``anchors`` is (run_id, kind, texts); without it each run's first step is
    the anchor and coverage is null.  ``drift``, ``judged`` and ``covered`` take
    the place of the model-free scores, as (run_id, ordinal, ...) tables.
    ``dealt`` as in ``drift.bag_drift``.
    """
    if nli and judged is None:
        own = steps.withColumn("w", word_set(F.col("text"))).withColumn("e", overlap(F.lag("w").over(by_run()), F.col("w")))
    else:
        own = steps.withColumn("e", F.lit(None).cast("struct<entailment:double,neutral:double,contradiction:double>"))
    own = own.withColumn("c", certainty(F.col("text"), settings.lexicon))
    own = own.withColumn("certainty_delta", F.coalesce(clip(F.col("c.score") - F.lag("c.score").over(by_run())), F.lit(0.0)))
    own = own.select("run_id", "ordinal", "step_id", "step_num", "agent_name", "role", "text", F.col("e.entailment").alias("entailment"), F.col("e.contradiction").alias("contradiction"), F.col("c.score").alias("certainty"), "certainty_delta", F.col("c.conclusive").alias("conclusive"))
    if judged is not None:
        own = own.drop("entailment", "contradiction").join(judged.select("run_id", "ordinal", "entailment", "contradiction"), ["run_id", "ordinal"], "left")
    if drift is None:
        drift = bag_drift(steps, None if anchors is None else anchors.select("run_id", "texts"), buckets, dealt)
    own = own.join(drift.select("run_id", "ordinal", "drift_prev", "drift_anchor", "combined_drift"), ["run_id", "ordinal"], "left")
    if anchors is not None and covered is None:
        covered = coverage(steps, anchor_facts(anchors, settings), settings.profile.coverage_threshold)
    if covered is not None:
        own = own.join(covered, ["run_id", "ordinal"], "left")
    else:
        own = own.withColumn("coverage", F.lit(None).cast("double")).withColumn("omission", F.lit(None).cast("double"))
    own = own.withColumn("aggregate", aggregate_score(settings)).withColumn("flags", _flags(settings))
    return own.select(
        "run_id", "ordinal", "step_id", "step_num", "agent_name", "role", "drift_prev", "drift_anchor", "combined_drift", "entailment", "contradiction", "certainty", "certainty_delta", "conclusive", "coverage", "omission", "aggregate",
        (F.size("flags") > 0).alias("flagged"), F.transform("flags", lambda f: f["reason"]).alias("flag_reasons"), F.transform("flags", lambda f: f["code"]).alias("flag_codes"),
    )
