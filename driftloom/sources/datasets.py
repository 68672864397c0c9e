"""The three splits of a data set of runs: clean, injected and labelled ones."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let
from ..operators.inject import KINDS, drawn_index, injected


def _nested(steps: DataFrame, *fields: str) -> DataFrame:
    """run_id and steps: the fields of each step, in order."""
    rows = steps.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("pos", *fields))).alias("s"))
    return rows.select("run_id", F.transform("s", lambda s: F.struct(*[s[f].alias(f) for f in fields])).alias("steps"))


def clean_split(steps: DataFrame, domains: DataFrame) -> DataFrame:
    """id, domain, steps, n_steps of each run; ``domains`` is (run_id, domain)."""
    rows = _nested(steps, "step_id", "text").join(domains.select("run_id", "domain"), "run_id", "left")
    return rows.select(F.col("run_id").alias("id"), "domain", "steps", F.size("steps").alias("n_steps"))


def injected_split(steps: DataFrame, domains: DataFrame, seed: Callable[[Column], Column], kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """A row for each run and kind of error: the changed steps and where and how they were changed.

    ``domains`` is (run_id, domain), a row a run.  ``seed`` tells a run's seed
    from its run_id.  Runs of fewer than three steps have no rows.
    """
    parts = steps.select("run_id", F.lit(None).cast(domains.schema["domain"].dataType).alias("domain"), F.struct("pos", "step_id", "text").alias("step"))
    parts = parts.unionByName(domains.select("run_id", "domain", F.lit(None).cast(parts.schema["step"].dataType).alias("step")))
    # One aggregation puts a run together; its errors are columns of that row, so neither windows nor joins sort the texts again.
    runs = parts.where("run_id is not null").groupBy("run_id").agg(F.max("domain").alias("domain"), F.array_sort(F.collect_list("step")).alias("s")).where("size(s) > 2")
    own = seed(F.col("run_id"))

    def error(kind: str) -> Column:
        changed = lambda at: F.struct(F.lit(kind).alias("kind"), at.alias("at"), injected(F.get("s", at)["text"], kind, own, F.col("run_id")).alias("text"))
        return let(drawn_index(F.size("s"), kind, own, F.col("run_id")).cast("int"), changed)

    rows = runs.select("run_id", "domain", "s", F.explode(F.array(*map(error, kinds))).alias("e")).withColumn("o", F.get("s", F.col("e.at")))
    told = F.transform("s", lambda x, i: F.struct(x["step_id"].alias("step_id"), F.when(i == F.col("e.at"), F.col("e.text")).otherwise(x["text"]).alias("text")))
    return rows.select(
        F.concat("run_id", F.lit("--"), "e.kind").alias("id"), F.col("run_id").alias("source_id"), "domain", F.col("e.kind").alias("injection_kind"),
        F.col("o.step_id").alias("origin_step_id"), F.col("o.pos").alias("origin_step_index"), F.col("o.text").alias("original_text"), F.col("e.text").alias("injected_text"), told.alias("steps"), own.alias("seed"),
    )


def labelled_split(steps: DataFrame, chains: DataFrame, labels: DataFrame, passes: DataFrame) -> DataFrame:
    """Each chain with its steps and resolved label.

    ``chains`` is (run_id, question, source, model, temperature); ``labels`` is
    (run_id, cascade_occurred, origin_step, error_type, evidence, notes,
    label_agreement); ``passes`` (run_id, rater, cascade_occurred, origin_step,
    error_type) holds each rater's.  A chain without a label has the machine's
    place, ``machine_only``; annotator_labels is null below two passes.
    """
    by = passes.where("cascade_occurred is not null").groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("rater", "cascade_occurred", "origin_step", "error_type"))).alias("annotator_labels"))
    by = by.where("size(annotator_labels) > 1")
    rows = chains.join(_nested(steps, "step_id", "agent_name", "role", "text"), "run_id").join(labels, "run_id", "left").join(by, "run_id", "left")
    return rows.select(
        F.col("run_id").alias("id"), "question", "source", "model", "temperature", "steps", "cascade_occurred", "origin_step", "error_type", F.coalesce("evidence", F.lit("")).alias("evidence"),
        F.coalesce("notes", F.lit("")).alias("annotation_notes"), F.coalesce("label_agreement", F.lit("machine_only")).alias("label_agreement"), "annotator_labels",
    )
