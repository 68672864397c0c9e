"""Steps from lists, JSON arrays, JSON lines and folders of such files.

Payloads are read as variants, as the rules depend on the type that a value
has in the JSON.  Nothing but an unreadable file fails: what is odd becomes a
note, and a payload that is no object takes no position.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

KNOWN = ("step_id", "text", "agent_name", "role", "timestamp", "modality", "raw_ref", "confidence_raw", "metadata")


def _variant(path: str, kind: str) -> Column:
    return F.try_variant_get("j", f"$.{path}", kind)


def from_payloads(payloads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(steps, notes) of rows (run_id, idx, payload: JSON text); ``idx`` orders a run."""
    rows = payloads.select("run_id", "idx", F.try_parse_json("payload").alias("j"))
    rows = rows.withColumn("is_object", F.coalesce(F.schema_of_variant("j").startswith("OBJECT"), F.lit(False)))
    order = Window.partitionBy("run_id").orderBy("idx")
    # The position that a dropped payload would have had: how many objects came before it.
    rows = rows.withColumn("pos", F.coalesce(F.sum(F.col("is_object").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int"))
    dropped = rows.where(~F.col("is_object")).select("run_id", F.lit(0).alias("stage"), "pos", F.lit("not_an_object").alias("code"), F.format_string("payload at position %d ignored: not an object", "pos").alias("message"))
    own = rows.where("is_object").withColumn("m", F.col("j").cast("map<string,variant>"))
    has = lambda k: F.map_contains_key("m", F.lit(k))
    is_text = F.coalesce(F.schema_of_variant(F.element_at("m", "text")) == "STRING", F.lit(False))
    named = F.when(has("step_id"), _variant("step_id", "string")).otherwise(F.col("pos").cast("string"))
    extras = F.map_filter("m", lambda k, v: ~k.isin(*KNOWN))
    given = F.element_at("m", "metadata")
    mapped = F.coalesce(F.schema_of_variant(given).startswith("OBJECT"), F.lit(False))
    kept = F.when(mapped, F.try_variant_get("j", "$.metadata", "map<string,variant>"))
    odd = has("metadata") & ~mapped & F.coalesce(F.schema_of_variant(given) != "VOID", F.lit(False))
    kept = F.when(odd, F.create_map(F.lit("metadata"), given)).otherwise(kept)
    none = F.create_map().cast("map<string,variant>")
    kept = F.map_filter(F.coalesce(kept, none), lambda k, v: ~F.map_contains_key(extras, k))
    steps = own.select(
        "run_id", "pos", named.alias("step_id"), _variant("agent_name", "string").alias("agent_name"), _variant("role", "string").alias("role"),
        _variant("timestamp", "string").alias("timestamp_raw"), F.when(has("modality"), _variant("modality", "string")).otherwise(F.lit("text")).alias("modality"),
        _variant("raw_ref", "string").alias("raw_ref"), _variant("confidence_raw", "double").alias("confidence_raw"),
        F.map_concat(kept, extras).alias("metadata"), F.when(is_text, _variant("text", "string")).otherwise(F.lit("")).alias("text"),
    )
    def note(when: Column, code: str, message: Column) -> Column:
        return F.when(when, F.struct(F.lit(code).alias("code"), message.alias("message")))

    found = F.array_compact(F.array(
        note(~has("step_id"), "no_step_id", F.format_string("step at position %d: missing step_id, assigned %d", "pos", "pos")),
        note(~has("text"), "no_text", F.concat(F.lit("step "), F.coalesce(named, F.lit("null")), F.lit(": missing text (will be skipped in measurement)"))),
        note(has("text") & ~is_text, "text_not_string", F.concat(F.lit("step "), F.coalesce(named, F.lit("null")), F.lit(": text is not a string, treated as empty"))),
        note(odd, "odd_metadata", F.concat(F.lit("step "), F.coalesce(named, F.lit("null")), F.lit(": metadata is not an object, kept under its name"))),
    ))
    told = own.select("run_id", F.lit(0).alias("stage"), "pos", F.inline(found)).select("run_id", "stage", "pos", "code", "message")
    return steps, dropped.unionByName(told)


def from_lists(spark: SparkSession, runs: Mapping[str, Iterable]) -> tuple[DataFrame, DataFrame]:
    """(steps, notes) of lists of payloads by run."""
    rows = [(run, i, json.dumps(p, ensure_ascii=False)) for run, payloads in runs.items() for i, p in enumerate(payloads)]
    return from_payloads(spark.createDataFrame(rows, "run_id string, idx int, payload string"))


def payloads_of(texts: DataFrame) -> DataFrame:
    """run_id, idx, payload of whole files (run_id, value): lines of ``.jsonl`` files, elements of the array in others.

    Reading a file that holds no array raises an error.
    """
    lines = F.lower("run_id").endswith(".jsonl")
    whole = F.try_parse_json("value")
    array = F.when(F.coalesce(F.schema_of_variant(whole).startswith("ARRAY"), F.lit(False)), whole.cast("array<variant>")).otherwise(F.raise_error(F.concat(F.lit("not a JSON array of steps: "), F.col("run_id"))).cast("array<variant>"))
    by_line = F.filter(F.split("value", r"\r\n|\n|\r"), lambda x: x.rlike(r"\S"))
    each = F.when(lines, by_line).otherwise(F.transform(array, lambda v: F.to_json(v)))
    return texts.select("run_id", F.posexplode(each).alias("idx", "payload"))


def read_files(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(steps, notes) of one file, or of the ``.json`` and ``.jsonl`` files of a folder; a run is named by its file."""
    texts = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("run_id"), "value")
    return from_payloads(payloads_of(texts.where(F.lower("run_id").rlike(r"\.jsonl?$") | F.lit(not _is_folder(spark, path)))))


def _is_folder(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where).isDirectory()
