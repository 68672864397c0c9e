"""Scores by models in place of the model-free ones, with each run's failures kept to itself.

A run whose texts can't all be embedded is reported as a monitoring failure.
One whose neighbours can't all be judged keeps its drift and is degraded, with
a note.  One whose facts can't be judged only loses its coverage, with a note.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Settings
from .drift import consensus, dense_drift
from .scorers import ScoreTable, embed_with, judge_with
from .signals import anchor_facts
from .steps import by_run, densified


def _broken(rows: DataFrame) -> DataFrame:
    """run_id, message of the runs with an error."""
    return rows.groupBy("run_id").agg(F.min("error").alias("message")).where("message is not null")


def _notes(broken: DataFrame, stage: int, code: str, text: str) -> DataFrame:
    return broken.select("run_id", F.lit(stage).alias("stage"), F.lit(None).cast("int").alias("pos"), F.lit(code).alias("code"), F.concat(F.lit(text), "message").alias("message"))


def model_drift(steps: DataFrame, load: Callable, anchors: DataFrame | None = None, kept: ScoreTable | None = None) -> tuple[DataFrame, DataFrame]:
    """(drift, failures: run_id and message) of densified steps by an embedder; ``anchors`` is (run_id, texts)."""
    rows = embed_with(steps.select("run_id", "ordinal", "text"), "text", load, kept)
    failures, given = _broken(rows), None
    if anchors is not None:
        texts = embed_with(anchors.select("run_id", F.explode("texts").alias("text")), "text", load, kept)
        failures = failures.unionByName(_broken(texts)).groupBy("run_id").agg(F.min("message").alias("message"))
        given = consensus(texts.where("vector is not null"), "run_id", "vector")
    ok = rows.join(failures.select("run_id"), "run_id", "left_anti")
    return dense_drift(ok, "vector", given), failures


def model_entailment(steps: DataFrame, load: Callable, kept: ScoreTable | None = None) -> tuple[DataFrame, DataFrame]:
    """(judged, notes) of densified steps by a judge of pairs; a run with an error has no entailment at all."""
    pairs = steps.select("run_id", "ordinal", F.lag("text").over(by_run()).alias("premise"), "text")
    rows = judge_with(pairs, "premise", "text", load, kept)
    broken = _broken(rows)
    judged = rows.join(broken.select("run_id"), "run_id", "left_anti").select("run_id", "ordinal", "entailment", "neutral", "contradiction")
    return judged, _notes(broken, 3, "entailment_failed", "entailment failed, drift only: ")


def model_coverage(steps: DataFrame, anchors: DataFrame, load: Callable, settings: Settings = Settings(), kept: ScoreTable | None = None) -> tuple[DataFrame, DataFrame]:
    """(covered, notes): coverage and omission of densified steps by a judge; ``anchors`` is (run_id, kind, texts)."""
    pairs = steps.select("run_id", "ordinal", "text").join(anchor_facts(anchors, settings), "run_id").select("run_id", "ordinal", "text", F.posexplode("facts").alias("fact_idx", "fact"))
    rows = judge_with(pairs, "text", "fact", load, kept)
    broken = _broken(rows)
    held = F.coalesce(F.col("entailment") >= settings.profile.coverage_threshold, F.lit(False)).cast("double")
    covered = rows.join(broken.select("run_id"), "run_id", "left_anti").groupBy("run_id", "ordinal").agg(F.avg(held).alias("coverage"))
    covered = covered.withColumn("omission", F.greatest(F.lit(0.0), F.lag("coverage", 1, 1.0).over(by_run()) - F.col("coverage")))
    return covered, _notes(broken, 4, "coverage_failed", "coverage failed: ")


def scores(steps: DataFrame, embed: Callable | None = None, judge: Callable | None = None, anchors: DataFrame | None = None, settings: Settings = Settings(), embedded: ScoreTable | None = None, judgements: ScoreTable | None = None) -> dict:
    """Options for ``report.analyze`` of the same steps: what the given models' loaders score.

    ``embedded`` and ``judgements`` are tables of earlier scores of these models.
    """
    own, out, notes = densified(steps), {}, []
    if embed is not None:
        out["drift"], out["failures"] = model_drift(own, embed, None if anchors is None else anchors.select("run_id", "texts"), embedded)
    if judge is not None:
        out["judged"], said = model_entailment(own, judge, judgements)
        notes.append(said)
        if anchors is not None:
            out["covered"], said = model_coverage(own, anchors, judge, settings, judgements)
            notes.append(said)
    if notes:
        out["notes"] = notes[0] if len(notes) == 1 else notes[0].unionByName(notes[1])
    return out
