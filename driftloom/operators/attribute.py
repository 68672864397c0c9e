"""Candidate origins: the steps of a run that cross a threshold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Settings
from ..functions.vectors import ratio


def candidate_columns(signals: DataFrame, settings: Settings = Settings(), nli: bool = True, first: Column | None = None) -> DataFrame:
    """``signals`` with crossed, how many of drift and entailment a step crosses, and its confidence.

    Confidence is 0.6 by the share of signals crossed and 0.4 by the largest
    margin in units of its threshold, and a tenth more for a run's first.
    It is null for steps that cross nothing or a threshold of 0.  ``first``
    tells a run's first candidate; otherwise a window by run does.
    """
    t, tau = settings.profile.drift_threshold, settings.profile.entail_threshold
    fires = {c: F.coalesce(F.col(c) > t, F.lit(False)) for c in ("drift_prev", "drift_anchor")}
    margins = {c: F.when(f, ratio(F.col(c) - t, F.lit(float(t)))) for c, f in fires.items()}
    if nli:
        fires["entailment"] = F.coalesce(F.col("entailment") < tau, F.lit(False))
        margins["entailment"] = F.when(fires["entailment"], ratio(F.lit(tau) - F.col("entailment"), F.lit(float(tau))))
    number, unitless = F.lit(0), F.lit(False)
    for c, f in fires.items():
        number, unitless = number + f.cast("int"), unitless | (f & margins[c].isNull())
    rows = signals.withColumn("crossed", number)
    if first is None:
        first = F.row_number().over(Window.partitionBy("run_id").orderBy(F.col("crossed") == 0, "ordinal")) == 1
    plain = 0.6 * F.col("crossed") / len(fires) + 0.4 * F.least(F.lit(1.0), F.greatest(*margins.values()))
    boosted = F.when(first, F.least(F.lit(1.0), plain + 0.1)).otherwise(plain)
    return rows.withColumn("confidence", F.when((F.col("crossed") > 0) & ~unitless, F.round(boosted, 3)))


def candidates(signals: DataFrame, settings: Settings = Settings(), nli: bool = True) -> DataFrame:
    """run_id, ordinal, step_id, agent_name, signals, crossed, confidence of every step that crosses something."""
    rows = candidate_columns(signals, settings, nli).where("crossed > 0")
    return rows.select("run_id", "ordinal", "step_id", "agent_name", "drift_prev", "drift_anchor", "entailment", "aggregate", "crossed", "confidence")
