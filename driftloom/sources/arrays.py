"""JSON arrays of any size, read in ranges.

Spark's text reader cuts a file into blocks and, told that lines end at commas,
gives the pieces between these.  Whether a comma separates two elements of the
outermost array depends on all that is before it: is it in a string, and how
deep?  Both are found by combining prefixes.  A piece tells how many quotes it
has and by how much it changes the depth if it starts inside a string and if it
doesn't; pieces add up within their block, blocks within their file, so a task
puts the pieces of a block in order, or a row for each block of a file.  The pieces of an element are put together again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .ingest import from_payloads

#: A block has at most two to this power of pieces, however short they are.
PIECES = 15


def _deeper(text: Column) -> Column:
    return F.length(F.translate(text, "]}", "")) - F.length(F.translate(text, "[{", ""))


def _before(column: str, window) -> Column:
    return F.coalesce(F.sum(column).over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def _measured(pieces: DataFrame) -> DataFrame:
    """``odd`` (number of quotes), and the change of depth of a piece that starts outside (``deep0``) or inside (``deep1``) a string."""
    # A comma is never escaped in JSON, so an escape and what it escapes are in one piece.
    parts = F.split(F.regexp_replace("value", r"(?s)\\.", ""), '"', -1)
    every = lambda rest: F.array_join(F.filter(parts, lambda x, i: i % 2 == rest), "")
    return pieces.withColumns({"odd": (F.size(parts) - 1) % 2, "deep0": _deeper(every(0)), "deep1": _deeper(every(1))})


def elements(pieces: DataFrame) -> DataFrame:
    """run_id, idx, payload of the pieces between the commas of arrays (run_id, block, place, value).

    Blocks of a run, and pieces of a block by ``place``, are in the order of
    the text; where blocks begin makes no difference.  An empty array has no
    row, and so has a run without pieces.  A text that is no array, that ends
    early, or with an element that is no JSON raises an error.  A null value
    counts as empty.  An element is one value, of at most 2 GB.
    """
    key = ["run_id", "block"]
    in_block, in_run = Window.partitionBy(*key).orderBy("place"), Window.partitionBy("run_id").orderBy("block")
    rows = _measured(pieces.select(*key, "place", F.coalesce("value", F.lit("")).alias("value")))
    rows = rows.withColumn("inside", _before("odd", in_block) % 2)
    # By whether the block starts outside a string or inside.
    out = F.col("inside") == 0
    rows = rows.withColumns({"if0": F.when(out, F.col("deep0")).otherwise(F.col("deep1")), "if1": F.when(out, F.col("deep1")).otherwise(F.col("deep0"))})
    rows = rows.select(*key, "place", "value", "inside", "if0", "if1", "odd", _before("if0", in_block).alias("depth0"), _before("if1", in_block).alias("depth1"))

    blocks = rows.groupBy(*key).agg(F.sum("odd").alias("odd"), F.sum("if0").alias("if0"), F.sum("if1").alias("if1"))
    blocks = blocks.select("run_id", "block", "if0", "if1", (_before("odd", in_run) % 2).alias("starts_in"))
    blocks = blocks.withColumn("change", F.when(F.col("starts_in") == 0, F.col("if0")).otherwise(F.col("if1")))
    blocks = blocks.select("run_id", "block", "starts_in", _before("change", in_run).alias("base"))

    own = rows.drop("odd", "if0", "if1").join(blocks, key)
    depth = F.col("base") + F.when(F.col("starts_in") == 0, F.col("depth0")).otherwise(F.col("depth1"))
    parts_them = ((F.col("starts_in") + F.col("inside")) % 2 == 0) & (depth == 1)
    own = own.select(*key, "place", "value", parts_them.cast("int").alias("begins"))
    own = own.withColumn("idx", F.sum("begins").over(in_block.rowsBetween(Window.unboundedPreceding, 0)))

    counts = own.groupBy(*key).agg(F.sum("begins").alias("begun"))
    whole_run = Window.partitionBy("run_id")
    counts = counts.select("run_id", "block", _before("begun", in_run).alias("earlier"), F.sum("begun").over(whole_run).alias("last"))
    own = own.join(counts, key).select("run_id", (F.col("idx") + F.col("earlier")).alias("idx"), "last", F.struct("block", "place", "value").alias("piece"))

    joined = F.array_join(F.transform(F.array_sort(F.collect_list("piece")), lambda p: p["value"]), ",")
    found = own.groupBy("run_id", "idx").agg(joined.alias("payload"), F.first("last").alias("last"))
    opening, closing = r"^\s*\[", r"\]\s*$"
    first, last = F.col("idx") == 0, F.col("idx") == F.col("last")
    broken = (first & ~F.col("payload").rlike(opening)) | (last & ~F.col("payload").rlike(closing))
    text = F.when(first, F.regexp_replace("payload", opening, "")).otherwise(F.col("payload"))
    text = F.when(last, F.regexp_replace(text, closing, "")).otherwise(text)
    found = found.select("run_id", "idx", "last", broken.alias("broken"), text.alias("payload"))
    empty = ~F.col("broken") & (F.col("last") == 0) & ~F.col("payload").rlike(r"\S")
    # Brackets that close too early are the only fault that a lenient parser may pass over.
    bare = F.regexp_replace(F.regexp_replace("payload", r"(?s)\\.", ""), r'"[^"]*+"', "")
    closes_early = F.aggregate(F.split(F.regexp_replace(bare, r"[^\[\]{}]", ""), ""), F.struct(F.lit(0).alias("at"), F.lit(0).alias("least")), lambda s, c: F.struct((s["at"] + _deeper(c)).alias("at"), F.least(s["least"], s["at"] + _deeper(c)).alias("least")))["least"] < 0
    wrong = F.col("broken") | F.try_parse_json("payload").isNull() | closes_early
    error = F.raise_error(F.concat(F.lit("not a JSON array of steps: "), F.col("run_id"))).cast("string")
    return found.where(~empty).select("run_id", F.col("idx").cast("int").alias("idx"), F.when(wrong, error).otherwise(F.col("payload")).alias("payload"))


def pieces_of(spark: SparkSession, path: str) -> DataFrame:
    """run_id, block, place, value of the files under a path; a block is a part of one of Spark's, by ``PIECES``."""
    rows = spark.read.option("lineSep", ",").text(path).select(
        F.col("_metadata.file_path").alias("run_id"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("place"), "value")
    return rows.select("run_id", F.struct("start", F.shiftright("place", PIECES).alias("part")).alias("block"), "place", "value")


def read_arrays(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(steps, notes) of files with one JSON array of steps each, as ``read_files`` has them, however large the files are."""
    return from_payloads(elements(pieces_of(spark, path)))
