"""Steps of runs: which can be measured, and their order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from ..functions.text import measurable

#: Characters of text that one task is dealt; the rows of its words, which windows sort, are some forty times that in memory.
CHARS = 1 << 22
STEP_COLUMNS = ("run_id", "pos", "step_id", "agent_name", "role", "text")


def by_run() -> WindowSpec:
    """The one window of all per-run sequence expressions: one exchange serves them."""
    return Window.partitionBy("run_id").orderBy("ordinal")


def as_steps(df: DataFrame, run: str, pos: str, text: str = "text", role: str | None = None, agent: str | None = None) -> DataFrame:
    """Any table as steps; step_id is the position."""
    name = lambda c: F.col(c).cast("string") if c else F.lit(None).cast("string")
    return df.select(
        F.col(run).cast("string").alias("run_id"), F.col(pos).cast("int").alias("pos"), F.col(pos).cast("string").alias("step_id"),
        name(agent or role).alias("agent_name"), name(role).alias("role"), F.col(text).alias("text"),
    )


def dealt(steps: DataFrame, chars: int) -> DataFrame:
    """``steps`` partitioned by run, over as many tasks as ``chars``, all their characters, take; a run is never cut."""
    tasks = max(steps.sparkSession.sparkContext.defaultParallelism, -(-chars // CHARS))
    return steps.repartition(tasks, "run_id")


def densified(steps: DataFrame) -> DataFrame:
    """The measurable steps with ``ordinal``, from 0 by ``pos`` without gaps, and step_id as a number."""
    order = Window.partitionBy("run_id").orderBy("pos")
    kept = steps.where(measurable(F.col("text"))).withColumn("ordinal", F.row_number().over(order) - 1)
    return kept.withColumn("step_num", F.expr("try_cast(step_id as bigint)"))


def skip_notes(steps: DataFrame) -> DataFrame:
    """run_id, stage, pos, code, message for steps that can't be measured and for runs that have none that can."""
    ok = measurable(F.col("text"))
    skipped = steps.where(~ok).select("run_id", F.lit(1).alias("stage"), "pos", F.lit("skipped").alias("code"), F.format_string("step %s skipped: empty or non-text content", "step_id").alias("message"))
    empty = steps.groupBy("run_id").agg(F.bool_or(ok).alias("any")).where("not any")
    return skipped.unionByName(empty.select("run_id", F.lit(2).alias("stage"), F.lit(None).cast("int").alias("pos"), F.lit("empty").alias("code"), F.lit("no measurable steps in run").alias("message")))
