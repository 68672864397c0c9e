"""The verdict on each run: whether any of four extremes crosses its level."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Profile

#: Signal, whether its largest or smallest value counts, the profile's level, its name in reasons.
TRIGGERS = (
    ("aggregate", "max", "aggregate_threshold", "aggregate"),
    ("entailment", "min", "entail_collapse", "entailment collapse"),
    ("omission", "max", "omission_collapse", "omission"),
    ("drift_anchor", "max", "drift_collapse", "anchor drift"),
)


def extremes() -> list[Column]:
    """The extreme value of each signal and its step: of equals the largest step for a maximum, the smallest for a minimum.

    Steps are ordered as numbers, those that are none before all by their text.
    """
    out = []
    for signal, kind, _, _ in TRIGGERS:
        value = F.when(F.col(signal).isNotNull(), F.struct(F.col(signal).alias("value"), "step_num", "step_id"))
        out.append((F.max if kind == "max" else F.min)(value).alias(f"x_{signal}"))
    return out


def triggered(profile: Profile = Profile()) -> Column:
    """(code, reason) of each trigger that the run's extremes cross, in the order of TRIGGERS."""
    found = []
    for signal, kind, level_name, label in TRIGGERS:
        level = getattr(profile, level_name)
        if level is None:
            continue
        x, sign = F.col(f"x_{signal}"), ">" if kind == "max" else "<"
        crossed = x["value"] > level if kind == "max" else x["value"] < level
        found.append(F.when(crossed, F.struct(F.lit(signal).alias("code"), F.format_string(f"{label} %.3f {sign} {level} at step %s", x["value"], x["step_id"]).alias("reason"))))
    return F.array_compact(F.array(*found)) if found else F.array().cast("array<struct<code:string,reason:string>>")


def verdicts(signals: DataFrame, profile: Profile = Profile()) -> DataFrame:
    """run_id, verdict, verdict_codes, verdict_reasons of every run in ``signals``."""
    rows = signals.groupBy("run_id").agg(*extremes()).withColumn("f", triggered(profile))
    return rows.select("run_id", (F.size("f") > 0).alias("verdict"), F.transform("f", lambda x: x["code"]).alias("verdict_codes"), F.transform("f", lambda x: x["reason"]).alias("verdict_reasons"))
