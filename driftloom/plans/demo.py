"""Tables and settings of the registered queries.

Runs are conversations: a turn is a step, its role the agent.  The word lists
are stand-ins that occur in those texts, and so are thresholds, which lie off
round numbers so that no score ties with one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import Lexicon, Profile, Settings
from ..operators.steps import as_steps, densified

LEXICON = Lexicon(
    hedge_phrases=("of the",), certainty_phrases=("and the",), conclusive_phrases=("in the",),
    hedge_words=("of", "to"), certainty_words=("the", "and"), conclusive_words=("that",),
)
PROFILE = Profile(name="demo", drift_threshold=0.8011, entail_threshold=0.3003, aggregate_threshold=0.6007, entail_collapse=0.0601, drift_collapse=0.9513)
SETTINGS = Settings(profile=PROFILE, lexicon=LEXICON, external_roles=("system",))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def all_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_steps(table(spark, sf_dir, "conversations"), "conv_id", "turn", role="role")


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return densified(all_steps(spark, sf_dir))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as steps: the label is the run."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("label").cast("string").alias("run_id"), F.col("vec_id").alias("pos"), "embedding")
    return rows.withColumn("ordinal", F.row_number().over(Window.partitionBy("run_id").orderBy("pos")) - 1)


def r6(column) -> Column:
    """Rounded to six places; never a negative zero."""
    column = F.col(column) if isinstance(column, str) else column
    return F.round(column, 6) + F.lit(0.0)
