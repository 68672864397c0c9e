"""Thresholds from runs that are known to be clean."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Profile
from .places import percentile as at_share


def drift_values(drift: DataFrame) -> DataFrame:
    """value: the measured drifts of both kinds, pooled."""
    return drift.select(F.explode(F.array("drift_prev", "drift_anchor")).alias("value")).where("value is not null")


def calibration(drift: DataFrame, percentile: float = 95.0) -> DataFrame:
    """One row: threshold at the percentile (interpolated), mean and population deviation, rounded to 4 places, and how many values."""
    values = drift_values(drift)
    sums = values.agg(F.count("value").alias("n_measurements"), F.round(F.avg("value"), 4).alias("drift_mean"), F.round(F.stddev_pop("value"), 4).alias("drift_std"))
    level = at_share(values, "value", percentile / 100, "level").select(F.col("n").alias("n_measurements"), F.round("level", 4).alias("drift_threshold"))
    return sums.join(level, "n_measurements", "left").select("drift_threshold", "n_measurements", "drift_mean", "drift_std")


@dataclass(frozen=True)
class Calibration:
    profile: Profile
    n_runs: int
    n_measurements: int
    drift_mean: float
    drift_std: float
    percentile: float


def calibrate(steps: DataFrame, drift: DataFrame, percentile: float = 95.0, name: str = "calibrated") -> Calibration:
    """A profile with a drift threshold from clean runs; runs without a measured step count as runs."""
    row = calibration(drift, percentile).first()
    if not row["n_measurements"]:
        raise ValueError("no drift was measured: runs with two or more text steps are needed")
    runs = steps.select("run_id").distinct().count()
    return Calibration(Profile(name=name, drift_threshold=row["drift_threshold"]), runs, row["n_measurements"], row["drift_mean"], row["drift_std"], percentile)


def holdout(runs: DataFrame, order: str, first: int) -> DataFrame:
    """``runs`` with ``part``: calibrate for the ``first`` ones by ``order``, one value a run, then holdout."""
    chosen = runs.select(order).orderBy(order).limit(first).withColumn("part", F.lit("calibrate"))
    return runs.join(F.broadcast(chosen), order, "left").withColumn("part", F.coalesce("part", F.lit("holdout")))


def signal_percentiles(signals: DataFrame, percentile: float = 95.0) -> DataFrame:
    """One row with the percentile of each signal and the larger of both drifts as threshold."""
    p = percentile / 100
    row = signals.sparkSession.range(1)
    for name, share in (("drift_prev", p), ("drift_anchor", p), ("aggregate", p), ("entailment", 1 - p)):
        row = row.join(at_share(signals, name, share, name).select(F.lit(0).cast("long").alias("id"), name), "id", "left")
    return row.drop("id").withColumn("drift_threshold", F.greatest("drift_prev", "drift_anchor"))


def applied(signals: DataFrame, levels: DataFrame) -> DataFrame:
    """run_id and which variants fire, by the one row of ``levels`` that signal_percentiles made of other runs."""
    levels = F.broadcast(levels.select(F.lit(True).alias("_on"), *[F.col(c).alias(f"l_{c}") for c in ("drift_prev", "drift_anchor", "aggregate")]))
    rows = signals.withColumn("_on", F.lit(True)).join(levels, "_on")
    over = lambda c: F.coalesce(F.bool_or(F.col(c) > F.col(f"l_{c}")), F.lit(False))
    fired = rows.groupBy("run_id").agg(over("drift_prev").alias("prev"), over("drift_anchor").alias("anchor"), over("aggregate").alias("dual_nli"))
    return fired.withColumn("dual", F.col("prev") | F.col("anchor"))
