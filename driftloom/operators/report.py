"""The whole analysis: one nested report for each run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Settings
from .attribute import candidate_columns
from .classify import chosen, rule_aggregates, rule_columns, scored
from .signals import signals
from .steps import densified, skip_notes
from .verdict import extremes, triggered

ENGINE = "0.1.0"
STEP_FIELDS = ("ordinal", "step_id", "agent_name", "role", "drift_prev", "drift_anchor", "entailment", "contradiction", "certainty", "certainty_delta", "conclusive", "coverage", "omission", "aggregate", "flagged", "flag_reasons")


def analyze(steps: DataFrame, settings: Settings = Settings(), anchors: DataFrame | None = None, nli: bool = True, notes: DataFrame | None = None, failures: DataFrame | None = None, **scorers) -> tuple[DataFrame, DataFrame]:
    """(signals, reports) of all runs in ``steps``.

    The signals are aggregated once: extremes, what the rules need, the steps
    and the candidates of a run, by the partitioning that the windows have.
    A run's types and origins are reported only where its verdict is true.
    ``degraded`` is true where entailment was asked for and none could be
    had; a run whose confidence can't be had (a threshold of 0) is reported as
    a monitoring failure, without steps, and so is one in ``failures`` (run_id,
    message).  ``scorers`` are the tables of ``models.scores``.  Every run in ``steps`` has a report.
    """
    own = signals(densified(steps), settings, anchors, nli, **scorers)
    rows = candidate_columns(rule_columns(own, settings, nli), settings, nli)
    origin = F.when(F.col("crossed") > 0, F.struct("ordinal", F.col("step_id").alias("origin_step"), F.col("agent_name").alias("origin_agent"), "drift_prev", "drift_anchor", "entailment", "aggregate", "confidence"))
    runs = rows.groupBy("run_id").agg(
        *extremes(), *rule_aggregates(),
        F.array_sort(F.collect_list(F.struct(*STEP_FIELDS))).alias("steps"), F.array_sort(F.collect_list(origin)).alias("origins"),
        F.bool_or(F.col("entailment").isNotNull()).alias("judged"), F.bool_or((F.col("crossed") > 0) & F.col("confidence").isNull()).alias("unitless"),
    )
    runs = scored(runs.withColumn("f", triggered(settings.profile)), settings, nli).withColumn("verdict", F.size("f") > 0)
    only = lambda c: F.when(F.col("verdict"), c)
    runs = runs.select(
        "run_id", "verdict", "judged", "steps", F.transform("f", lambda x: x["reason"]).alias("verdict_reasons"),
        only(F.when(F.col("n") > 0, chosen(settings.class_cutoff, "any_flagged"))).alias("classification"), only(F.col("origins")).alias("attribution"), (F.col("verdict") & F.col("unitless")).alias("failed"),
    )
    said = skip_notes(steps)
    said = said.unionByName(notes) if notes is not None else said
    said = said.groupBy("run_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("stage", "pos", "message"))), lambda n: n["message"]).alias("notes"))
    rows = steps.select("run_id").distinct().join(runs, "run_id", "left").join(said, "run_id", "left")
    rows = rows.join(failures.select("run_id", "message"), "run_id", "left") if failures is not None else rows.withColumn("message", F.lit(None).cast("string"))
    failed = F.coalesce("failed", F.lit(False)) | F.col("message").isNotNull()
    empty = lambda c: F.when(failed, F.slice(F.col(c), 1, 0)).otherwise(F.coalesce(c, F.lit(None)))
    p = settings.profile
    report = rows.select(
        "run_id",
        (F.coalesce("verdict", F.lit(False)) & ~failed).alias("verdict"),
        empty("verdict_reasons").alias("verdict_reasons"), empty("steps").alias("steps"), empty("classification").alias("classification"), empty("attribution").alias("attribution"),
        F.struct(*[F.lit(getattr(p, k)).cast("string" if k == "name" else "double").alias("profile" if k == "name" else k) for k in p.__dataclass_fields__]).alias("thresholds"),
        F.struct(F.lit("model" if "drift" in scorers else "bag of words").alias("embedding"), F.when(F.coalesce("judged", F.lit(False)), "model" if "judged" in scorers else "word overlap").alias("nli")).alias("models"),
        F.lit(ENGINE).alias("engine_version"), F.coalesce("notes", F.array().cast("array<string>")).alias("notes"),
        (failed | (~F.coalesce("judged", F.lit(False)) if nli else F.lit(False))).alias("degraded"),
        F.coalesce("message", F.when(failed, "a threshold of 0 leaves no unit for margins")).alias("monitoring_failure"),
    )
    lists = ("verdict_reasons", "steps", "classification", "attribution")
    for c in lists:
        report = report.withColumn(c, F.coalesce(c, F.array().cast(report.schema[c].dataType)))
    return own, report
