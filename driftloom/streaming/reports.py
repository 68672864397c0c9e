"""Reports of runs that come in batches, each entered once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.report import analyze
from ..sources.folder import GrowingFolder
from .log import SharedFolder


class ReportTable:
    """Report rows by batch under ``base``, with a ledger of the batches that are whole.

    A batch is written under its number, then entered; ``rows`` reads entered
    batches only.  A process that dies between the two leaves rows that nobody
    reads and that the next attempt writes anew, so no report is there twice
    and none is lost.  Entering a batch again changes nothing.
    """

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base
        self._ledger = SharedFolder(spark, f"{base}/entered")

    def has(self, batch: int) -> bool:
        return self._ledger.exists(f"{batch:012d}")

    def enter(self, batch: int, reports: DataFrame) -> bool:
        """Write and enter the reports of a batch; whether it was new."""
        if self.has(batch):
            return False
        reports.write.mode("overwrite").parquet(self._rows(batch))
        self._ledger.write(f"{batch:012d}", "")
        return True

    def _rows(self, batch: int) -> str:
        return f"{self.base}/rows/batch={batch}"

    @property
    def rows(self) -> DataFrame | None:
        """The reports of all entered batches; nothing while there is none."""
        paths = [self._rows(int(name)) for name in self._ledger.names()]
        return self.spark.read.parquet(*paths) if paths else None


def report_new(folder: GrowingFolder, table: ReportTable, **options) -> int:
    """Analyse and enter the batches of a folder that aren't entered; how many these were.

    A run is a file and a file is in one batch, so each run is analysed once,
    as a whole.  Files that were put aside have a note and no report.
    ``options`` go to ``analyze``.
    """
    new = 0
    for batch in folder.batches():
        if not table.has(batch):
            steps, notes = folder.batch(batch)
            _, reports = analyze(steps, notes=notes.where("code <> 'unreadable'"), **options)
            new += table.enter(batch, reports)
    return new
