"""Signals, rules and candidates of runs that are too long for one task.

A run is cut into stretches of a fixed number of steps.  What a stretch needs
from outside are few rows: the run's first step, the step before, the last one
that was measured, how many were.  These are carried into it as guests, and a
stretch with its guests is a run of its own to the operators for whole runs,
so both ways give the same rows.  Guests are one row in ``size``; a task holds
a stretch, whatever the length of the run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Settings
from ..functions.text import measurable
from ..sources.shared import written
from .attribute import candidate_columns
from .classify import TYPES, rule_aggregates, rule_columns, scored
from .signals import signals

#: Steps of a stretch.
SIZE = 4096
_MARK = "\u0000"


def numbered(steps: DataFrame) -> DataFrame:
    """What ``steps.densified`` gives, by ranges of (run, position): each task numbers its part, and parts are counted."""
    kept = steps.where(measurable(F.col("text"))).withColumn("step_num", F.expr("try_cast(step_id as bigint)"))
    dealt = written(kept.repartitionByRange("run_id", "pos").withColumn("_part", F.spark_partition_id()), "dealt")
    before = Window.partitionBy("run_id").orderBy("_part")
    starts = dealt.groupBy("run_id", "_part").agg(F.count(F.lit(1)).alias("_n")).withColumn("_start", F.sum("_n").over(before) - F.col("_n")).drop("_n")
    own = dealt.withColumn("_at", F.row_number().over(Window.partitionBy("run_id", "_part").orderBy("pos")) - 1)
    own = own.join(starts, ["run_id", "_part"])
    return own.withColumn("ordinal", (F.col("_start") + F.col("_at")).cast("int")).drop("_part", "_start", "_at")


def _stretch(size: int) -> Column:
    return F.floor(F.col("ordinal") / size).cast("long")


def _named(run: str | Column, stretch: Column) -> Column:
    """The id of a stretch as a run."""
    return F.concat(F.col(run) if isinstance(run, str) else run, F.lit(_MARK), stretch.cast("string"))


def _at_home(rows: DataFrame, size: int) -> DataFrame:
    """Without guests, under the runs' own ids."""
    number = F.substring_index("run_id", _MARK, -1)
    run = F.col("run_id").substr(F.lit(1), F.length("run_id") - F.length(number) - 1)
    return rows.where(number == _stretch(size).cast("string")).withColumn("run_id", run)


def _lengths(steps: DataFrame, size: int) -> DataFrame:
    """run_id and the number of its last stretch."""
    return steps.groupBy("run_id").agg(F.max("ordinal").alias("ordinal")).select("run_id", _stretch(size).alias("_last"))


def long_signals(steps: DataFrame, settings: Settings = Settings(), anchors: DataFrame | None = None, nli: bool = True, buckets: int | None = 128, size: int = SIZE) -> DataFrame:
    """``signals.signals`` of ``numbered`` steps, stretch by stretch."""
    ends = _lengths(steps, size)
    own = steps.withColumn("_s", _stretch(size))
    before = own.where((F.col("ordinal") > 0) & ((F.col("ordinal") + 1) % size == 0)).withColumn("_s", F.col("_s") + 1)
    first = own.where("ordinal = 0").join(ends.where("_last > 0"), "run_id").withColumn("_s", F.explode(F.sequence(F.lit(1), F.col("_last")))).drop("_last")
    with_guests = own.unionByName(before).unionByName(first)
    apart = with_guests.withColumn("run_id", _named("run_id", F.col("_s"))).drop("_s")
    if anchors is not None:
        each = anchors.join(ends, "run_id").withColumn("_s", F.explode(F.sequence(F.lit(0), F.col("_last"))))
        anchors = each.withColumn("run_id", _named("run_id", F.col("_s"))).select("run_id", "kind", "texts")
    return _at_home(signals(apart, settings, anchors, nli, buckets), size)


def long_rule_scores(found: DataFrame, settings: Settings = Settings(), nli: bool = True, size: int = SIZE) -> DataFrame:
    """``classify.rule_scores`` of signals, stretch by stretch."""
    same_step = Window.partitionBy("run_id", "step_id").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    own = found.withColumn("role", F.last("role").over(same_step)).withColumn("_s", _stretch(size))
    measured = F.when(F.col("drift_anchor").isNotNull(), F.col("ordinal"))
    row = F.struct(*found.columns)
    sums = own.groupBy("run_id", "_s").agg(F.max_by(row, measured).alias("_row"), F.count(measured).alias("_n"))
    order = Window.partitionBy("run_id").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("run_id", "_s", F.last("_row", True).over(order).alias("_row"), F.coalesce(F.sum("_n").over(order), F.lit(0)).alias("_n"))
    guests = sums.where("_row is not null").select("_s", "_row.*")
    apart = own.unionByName(guests).withColumn("run_id", _named("run_id", F.col("_s"))).drop("_s")
    rows = rule_columns(apart, settings, nli)
    ahead = sums.select(_named("run_id", F.col("_s")).alias("run_id"), "_n")
    # the guest is a stretch's first measured row, and the last of those ahead
    rows = rows.join(ahead, "run_id").withColumn("_rank", F.col("_rank") + F.greatest(F.col("_n") - 1, F.lit(0))).drop("_n")
    runs = _at_home(rows, size).groupBy("run_id").agg(*rule_aggregates()).where("n > 0")
    return scored(runs, settings, nli).select("run_id", F.col("any_flagged").alias("flagged"), *TYPES, "rationales")


def long_candidates(found: DataFrame, settings: Settings = Settings(), nli: bool = True) -> DataFrame:
    """``attribute.candidates`` of signals: a run's first candidate is found by an aggregation."""
    crossing = candidate_columns(found, settings, nli, first=F.lit(False)).where("crossed > 0")
    firsts = crossing.groupBy("run_id").agg(F.min("ordinal").alias("_first"))
    rows = candidate_columns(crossing.drop("crossed", "confidence").join(firsts, "run_id"), settings, nli, first=F.col("ordinal") == F.col("_first"))
    return rows.select("run_id", "ordinal", "step_id", "agent_name", "drift_prev", "drift_anchor", "entailment", "aggregate", "crossed", "confidence")


def long_consecutive(found: DataFrame, size: int = SIZE) -> DataFrame:
    """``evaluate.consecutive_flags`` of signals: a stretch has the next one's first step as a guest."""
    own = found.select("run_id", "ordinal", "flagged").withColumn("_s", _stretch(size))
    after = own.where((F.col("ordinal") > 0) & (F.col("ordinal") % size == 0)).withColumn("_s", F.col("_s") - 1)
    ahead = F.lead("flagged").over(Window.partitionBy("run_id", "_s").orderBy("ordinal"))
    pairs = own.unionByName(after).withColumn("_pair", F.col("flagged") & F.coalesce(ahead, F.lit(False)))
    return pairs.groupBy("run_id").agg(F.bool_or("_pair").alias("consecutive"))
