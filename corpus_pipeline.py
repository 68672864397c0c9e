"""A corpus pipeline of five operators; each stage reads what the one before wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftloom.llm import common, decontam, langid, mixing, nearset, pii


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can't be told go: no letters, or no likely language.

    Null and empty texts go, very long ones are read whole, repeated rows are
    judged alike, all columns stay.  If no row has a language to learn from,
    only texts without a letter go.  No rows give none.
    """
    return langid.accepted(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8) stays: the smallest doc_id.

    Texts without a word are one group; very long ones are compared whole.
    Rows with a null doc_id, and rows that repeat the smallest doc_id, stay.
    All columns stay, whatever their names.  No rows give none.
    """
    return nearset.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap the benchmark go.

    Null and empty texts overlap nothing and stay; very long ones are read
    whole; repeated rows go or stay together, null doc_ids are ids like any
    other.  All columns stay.  No rows, or no benchmark items, change nothing.
    """
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in texts is replaced by its kind; n_chars follows the text.

    Null texts stay null (n_chars, too), very long ones are read whole, repeated
    rows are changed alike.  Overlapping spans become one.  All rows and
    columns stay; without an n_chars column there is none after.
    """
    clean = pii.redact(docs)
    sized = lambda c: F.length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"`{c}`")
    return clean.select(*map(sized, clean.columns))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, all columns, with size, source_size, target, taken and the draws of their copies (shard, place, words).

    Texts without a word are never taken; a very long one is a document like
    any other.  Null sources are one source; repeated rows count each by
    itself; ties are broken by hashes.  A new column whose name is taken gets
    ``_mix`` behind it.  No rows give none.
    """
    return mixing.drawn(docs)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("redaction", redaction),
    ("mixture", mixture),
]

#: The fitted language model and MinHash groups can't be stated in SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written as Parquet and reread; what a stage leaves besides goes with it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    since = common.made()
    for name, stage in STAGES[:-1]:
        docs = common.cut(stage(spark, docs, sf_dir), name)
        common.drop(spark, since, keep=1)
    return STAGES[-1][1](spark, docs, sf_dir)
