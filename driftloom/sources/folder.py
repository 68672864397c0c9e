"""A folder of runs that grows: each file is read once, what can't be read is put aside."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ingest import from_payloads, payloads_of

#: Files that one batch takes.
FILES = 1000


def sorted_out(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files that can be read, notes of the others) of whole files (run_id, value).

    JSON lines can always be read, line by line; any other file must be an
    array.  A note is run_id, stage, pos, code and message, as steps have them.
    """
    array = F.coalesce(F.schema_of_variant(F.try_parse_json("value")).startswith("ARRAY"), F.lit(False))
    fine = F.col("value").isNotNull() & (F.lower("run_id").endswith(".jsonl") | array)
    bad = texts.where(~F.coalesce(fine, F.lit(False)))
    note = F.concat(F.lit("file put aside: not a JSON array of steps: "), "run_id")
    return texts.where(fine), bad.select("run_id", F.lit(0).alias("stage"), F.lit(None).cast("int").alias("pos"), F.lit("unreadable").alias("code"), note.alias("message"))


class GrowingFolder:
    """Steps and notes of the ``.json`` and ``.jsonl`` files of a folder, kept as tables under ``base``.

    ``take_in`` reads the files that have come since it was last called, by
    any process: the stream's log knows them.  A batch writes under its number
    and writes anew if it runs again, so no file is taken in twice and none is
    lost.  A file that can't be read is one note and keeps nobody up.  A file's
    steps are numbered in it, and its path is the run's name.
    """

    def __init__(self, spark: SparkSession, path: str, base: str, files: int = FILES):
        self.spark, self.path, self.base, self._files = spark, path, base, files

    def take_in(self) -> None:
        stream = self.spark.readStream.format("text").option("wholetext", True).option("maxFilesPerTrigger", self._files).load(self.path)
        texts = stream.select(F.col("_metadata.file_path").alias("run_id"), "value").where(F.lower("run_id").rlike(r"\.jsonl?$"))
        texts.writeStream.foreachBatch(self._batch).option("checkpointLocation", f"{self.base}/seen").trigger(availableNow=True).start().awaitTermination()

    def _batch(self, texts: DataFrame, batch: int) -> None:
        good, put_aside = sorted_out(texts)
        steps, notes = from_payloads(payloads_of(good))
        for name, rows in (("steps", steps), ("notes", notes.unionByName(put_aside))):
            rows.write.mode("overwrite").parquet(f"{self.base}/{name}/batch={batch}")

    def batches(self) -> list[int]:
        """Numbers of the batches that are written as a whole: notes come last."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.base}/notes/batch=*/_SUCCESS")
        found = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(path)
        return sorted(int(s.getPath().getParent().getName().split("=")[1]) for s in found or [])

    def batch(self, number: int) -> tuple[DataFrame, DataFrame]:
        """(steps, notes) of one batch."""
        steps, notes = (self.spark.read.parquet(f"{self.base}/{name}/batch={number}") for name in ("steps", "notes"))
        return steps, notes

    def _table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.base}/{name}").drop("batch")

    @property
    def steps(self) -> DataFrame:
        return self._table("steps")

    @property
    def notes(self) -> DataFrame:
        return self._table("notes")
