"""A table of annotators' forms that grows by deltas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import written

#: Folders that a table's rows are dealt to by their key.
BUCKETS = 256


class FormTable:
    """One form for each id, in a folder that executors share, its rows filed by a hash of the key.

    A delta reads and writes only the buckets that its ids are in.  New ids are
    appended; forms that replace others rewrite their buckets, each as a whole.
    A table has one writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, fields: str, buckets: int = BUCKETS):
        self.spark, self.path, self.key, self.buckets = spark, path, key, buckets
        self._schema = spark.createDataFrame([], fields).schema

    def _filed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("_bucket", F.pmod(F.xxhash64(F.col(self.key).cast("string")), F.lit(self.buckets)).cast("int"))

    def _there(self) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def read(self, of: DataFrame | None = None) -> DataFrame:
        """All forms, or those in the buckets of the ids of ``of``: no more than ``buckets`` numbers are fetched to prune by."""
        if not self._there():
            return self._filed(self.spark.createDataFrame([], self._schema)) if of is not None else self.spark.createDataFrame([], self._schema)
        rows = self.spark.read.schema(self._filed(self.spark.createDataFrame([], self._schema)).schema).parquet(self.path)
        if of is None:
            return rows.select(*self._schema.names)
        wanted = [r[0] for r in self._filed(of).select("_bucket").distinct().collect()]
        return rows.where(F.col("_bucket").isin(wanted))

    def ensure(self, ids: DataFrame) -> None:
        """A blank form for each id that has none; null ids have no form."""
        asked = written(ids.select(self.key).where(F.col(self.key).isNotNull()).distinct(), "asked")
        new = asked.join(self.read(asked).select(self.key), self.key, "left_anti")
        for f in self._schema.fields:
            if f.name != self.key:
                new = new.withColumn(f.name, F.lit(None).cast(f.dataType))
        new = written(new.select(*self._schema.names), "blank")
        if new.limit(1).count():
            self._filed(new).repartition("_bucket").write.mode("append").partitionBy("_bucket").parquet(self.path)

    def put(self, forms: DataFrame) -> None:
        """``forms`` in place of those of their ids, one a key."""
        forms = written(forms.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self._schema.fields]), "forms")
        kept = self.read(forms).join(forms.select(self.key), self.key, "left_anti")
        merged = written(kept.select(*self._schema.names).unionByName(forms), "merged")  # a table can't be overwritten while it is read
        self._filed(merged).repartition("_bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_bucket").parquet(self.path)
