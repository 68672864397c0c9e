"""Semantic drift of each step against the step before and against an anchor.

Bags of words stay sparse: one row a step and term, all partitioned by run, so
the counting, both windows and the sums share one exchange.  Dense vectors use
lag and first over the same window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import words
from ..functions.vectors import cosine, mean_present, ratio
from .steps import by_run


def _ended(df: DataFrame, own_anchor: bool) -> DataFrame:
    """drift_prev, drift_anchor and their mean; without an anchor of its own a run's first step has none."""
    if not own_anchor:
        df = df.withColumn("drift_anchor", F.when(F.col("ordinal") > 0, F.col("drift_anchor")))
    return df.withColumn("combined_drift", F.coalesce(mean_present(F.col("drift_prev"), F.col("drift_anchor")), F.lit(0.0)))


def bag_drift(steps: DataFrame, anchors: DataFrame | None = None, buckets: int | None = None, dealt: bool = False) -> DataFrame:
    """run_id, ordinal, drift_prev, drift_anchor, combined_drift of densified steps.

    A step's vector counts its words or, with ``buckets``, its words' crc32 by
    that many.  The anchor is the run's first step or, for runs in ``anchors``
    (run_id, texts: array of string), the mean of those texts' vectors.
    ``dealt`` steps are partitioned by run already and are not moved again.
    """
    term = lambda w: F.crc32(w) % buckets if buckets else w
    counts = (steps if dealt else steps.repartition("run_id")).select("run_id", "ordinal", F.explode_outer(F.transform(words(F.col("text")), term)).alias("term"))
    counts = counts.groupBy("run_id", "ordinal", "term").agg(F.count("term").alias("n"))
    if anchors is not None:
        given = anchors.select("run_id", F.size("texts").alias("k"), F.explode("texts").alias("text"))
        given = given.select("run_id", "k", F.explode(F.transform(words(F.col("text")), term)).alias("term"))
        given = given.groupBy("run_id", "term").agg((F.count("term") / F.first("k")).alias("w"))
        size = given.groupBy("run_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("anchor_norm"))
        counts = counts.join(given, ["run_id", "term"], "left").join(size, "run_id", "left").withColumn("own_anchor", F.col("anchor_norm").isNotNull())
    else:
        counts = counts.withColumn("w", F.lit(None).cast("double")).withColumn("anchor_norm", F.lit(None).cast("double")).withColumn("own_anchor", F.lit(False))
    by_term = Window.partitionBy("run_id", "term").orderBy("ordinal")
    last, last_at = F.lag("n").over(by_term), F.lag("ordinal").over(by_term)
    first = F.max(F.when(F.col("ordinal") == 0, F.col("n"))).over(Window.partitionBy("run_id", "term"))
    n = F.col("n").cast("double")
    rows = counts.select(
        "run_id", "ordinal", "own_anchor", "anchor_norm", (n * n).alias("nn"),
        F.when(last_at == F.col("ordinal") - 1, n * last).alias("prev"),
        F.when(F.col("own_anchor"), n * F.coalesce("w", F.lit(0.0))).otherwise(n * first).alias("anch"),
    )
    sums = rows.groupBy("run_id", "ordinal").agg(
        F.sqrt(F.sum("nn")).alias("norm"), F.coalesce(F.sum("prev"), F.lit(0.0)).alias("prev"), F.coalesce(F.sum("anch"), F.lit(0.0)).alias("anch"),
        F.max("own_anchor").alias("own"), F.max("anchor_norm").alias("given_norm"),
    )
    zero = F.lit(0.0)
    before, start = F.lag("norm").over(by_run()), F.first("norm").over(by_run())
    out = sums.select(
        "run_id", "ordinal", "own",
        (1 - ratio(F.col("prev"), F.col("norm") * before, zero)).alias("drift_prev"),
        (1 - ratio(F.col("anch"), F.col("norm") * F.coalesce("given_norm", start), zero)).alias("drift_anchor"),
    )
    out = out.withColumn("drift_anchor", F.when(F.col("own") | (F.col("ordinal") > 0), F.col("drift_anchor")))
    return _ended(out, True).drop("own")


def dense_drift(steps: DataFrame, vector: str, anchors: DataFrame | None = None) -> DataFrame:
    """The same from a vector column; ``anchors`` is (run_id, anchor: a vector)."""
    own = steps.select("run_id", "ordinal", F.col(vector).alias("v"))
    if anchors is not None:
        own = own.join(anchors.select("run_id", "anchor"), "run_id", "left")
    else:
        own = own.withColumn("anchor", F.lit(None).cast(own.schema["v"].dataType))
    given = F.col("anchor").isNotNull()
    own = own.withColumn("prev", F.lag("v").over(by_run())).withColumn("start", F.first("v").over(by_run())).withColumn("own", given)
    out = own.select(
        "run_id", "ordinal", (1 - cosine(F.col("v"), F.col("prev"))).alias("drift_prev"),
        F.when(F.col("own") | (F.col("ordinal") > 0), 1 - cosine(F.col("v"), F.coalesce("anchor", "start"))).alias("drift_anchor"),
    )
    return _ended(out, True)


def consensus(vectors: DataFrame, run: str, vector: str) -> DataFrame:
    """run_id, anchor: the element-wise mean of each run's vectors.

    Each task adds up the vectors of a run that it meets, so one row for each
    run and task is shuffled, and the tasks' sums are added by run.  Null
    vectors and elements don't count; of vectors of different lengths each
    place has the mean of those that have it.  A run without vectors has no row.
    """
    own = vectors.select(F.col(run).cast("string").alias("run_id"), F.col(vector).cast("array<double>").alias("v")).where("v is not null")
    parts = own.select("run_id", "v", F.transform("v", lambda x: x.isNotNull().cast("double")).alias("n")).mapInArrow(_added, "run_id string, v array<double>, n array<double>")
    whole = parts.repartition("run_id").mapInArrow(_added, "run_id string, v array<double>, n array<double>")
    return whole.select("run_id", F.zip_with("v", "n", lambda s, n: F.try_divide(s, n)).alias("anchor"))


def _added(batches, most: int = 20_000):
    """(run_id, sums, counts) of rows of the same: all of a run that this task meets, as long as ``most`` runs are at hand."""
    import numpy as np
    import pyarrow as pa

    held: dict = {}

    def done():
        runs = list(held)
        return pa.RecordBatch.from_arrays([pa.array(runs, pa.string()), *[pa.array([held[r][i] for r in runs], pa.list_(pa.float64())) for i in (0, 1)]], ["run_id", "v", "n"])

    for batch in batches:
        for run, v, n in zip(batch.column(0).to_pylist(), *[_rows(batch.column(i)) for i in (1, 2)]):
            v = np.where(n > 0, v, 0.0)
            if run in held and len(held[run][0]) == len(v):
                held[run][0] += v
                held[run][1] += n
            elif run in held:
                wide = max(len(v), len(held[run][0]))
                held[run] = [np.pad(a, (0, wide - len(a))) + np.pad(b, (0, wide - len(b))) for a, b in zip(held[run], (v, n))]
            else:
                held[run] = [v, n.copy()]
        if len(held) > most:  # a run may come again: its sums are added by whoever reads them
            yield done()
            held = {}
    if held:
        yield done()


def _rows(lists):
    """The arrays of a list column, nulls as NaN."""
    values, ends = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
    return [values[a:b] for a, b in zip(ends[:-1], ends[1:])]


def most_drifted(drift: DataFrame) -> DataFrame:
    """Each run's step with the largest mean drift, the first of equals; runs with no measured step have none."""
    best = F.max(F.struct("combined_drift", (-F.col("ordinal")).alias("back")))
    some = F.col("drift_prev").isNotNull() | F.col("drift_anchor").isNotNull()
    return drift.where(some).groupBy("run_id").agg(best.alias("b")).select("run_id", (-F.col("b.back")).alias("ordinal"), F.col("b.combined_drift").alias("combined_drift"))


def drift_codes(threshold: float | Column) -> Column:
    """Codes of the drift thresholds that are exceeded."""
    return F.array_compact(F.array(*[F.when(F.col(c) > threshold, F.lit(c)) for c in ("drift_prev", "drift_anchor")]))


def flagged_steps(df: DataFrame) -> DataFrame:
    return df.where("flagged")
