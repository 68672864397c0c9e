"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Heavy keys are those with more than one in so many rows; there are at most so many.
HEAVY_SHARE = 1000
_OWN: list[str] = []
#: Tables that ``cut`` wrote and no one has dropped.
_CUT: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``, or what setCheckpointDir was given.

    Where neither is set, a local session gets a temporary folder that goes
    with the process; on a cluster that would be another one on each machine,
    so there it is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    given = spark.sparkContext._jsc.sc().getCheckpointDir()
    if given.isDefined():
        return given.get()
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if not _OWN:
        _OWN.append(tempfile.mkdtemp(prefix="checkpoints_"))
        atexit.register(shutil.rmtree, _OWN[0], True)
    return "file://" + _OWN[0]


def cut(df: DataFrame, name: str, files: int | None = None) -> DataFrame:
    """Write ``df`` as a Parquet table to the shared folder and read it back.

    This ends the lineage there: a lost executor costs no recomputation beyond
    the table, and every later reader sees the same rows.  ``files`` limits the
    number of files of a table whose rows are bounded.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    _CUT.append(path)
    (df if files is None else df.coalesce(files)).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def made() -> int:
    """A mark for ``drop``: what is cut from now on comes after it."""
    return len(_CUT)


def drop(spark: SparkSession, since: int, keep: int = 0) -> None:
    """Delete the tables cut since a mark, but for the last ``keep``; nothing may read them any more."""
    for path in _CUT[since : len(_CUT) - keep]:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    del _CUT[since : len(_CUT) - keep]


def bounded(df: DataFrame, rows: int) -> bool:
    """Whether ``df`` has at most ``rows`` rows; looks at no more than one beyond."""
    return df.limit(rows + 1).count() <= rows


def columns_apart(df: DataFrame, *needed: str) -> DataFrame:
    """Only the named columns: others, whatever their names, can't clash."""
    return df.select(*[F.col(f"`{c}`") for c in needed])


def held_out(doc_id: Column, mod: int, rest: int) -> Column:
    """Whether a row is kept out of learning: by the crc32 of its id as text."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % mod == rest, F.lit(False))


def lookup(left: DataFrame, right: DataFrame, key: str, weight: str, total: int) -> DataFrame:
    """Left join of many small rows with one row a key, safe with hot keys.

    ``weight`` is a column of ``right`` with the number of left rows of its key.
    Keys with over one thousandth of the ``total`` are at most a thousand, so
    these are broadcast; the others are joined by a shuffle.
    """
    hot = right.where(F.col(weight) * HEAVY_SHARE > total)
    cold = right.where(F.col(weight) * HEAVY_SHARE <= total)
    names = [c for c in right.columns if c != key]
    near = left.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), key, "left")
    hit = near.where("_hot").drop("_hot")
    rest = near.where("_hot is null").drop("_hot", *names)
    return hit.unionByName(rest.join(cold, key, "left"))
