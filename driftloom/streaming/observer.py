"""Watching runs while they go on, and replaying finite streams of steps."""

from __future__ import annotations

import json
import uuid
import warnings
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from ..sources.ingest import from_payloads
from ..sources.shared import shared_dir
from .log import Ledger, SharedFolder, StepLog
from .state import IDLE_MS, OUT, live_drift

#: A line of the log: a payload, and what the stream needs of it if it is a step.
SEEN = "run_id string, idx long, payload string, pos int, step_id string, text string"
#: What streams with keyed state need; a run that idles makes no batches.
SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


def started(spark: SparkSession, stream: DataStreamWriter) -> StreamingQuery:
    """Start a stream with ``SETTINGS``, which it keeps; the session gets its own back."""
    before = {k: spark.conf.get(k, None) for k in SETTINGS}
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    try:
        return stream.start()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def replay(spark: SparkSession, events: DataFrame, threshold: float) -> DataFrame:
    """The rows of a finite stream (run_id, idx, pos, step_id, text), run to its end."""
    base = f"{shared_dir(spark)}/replay-{uuid.uuid4().hex}"
    writer = live_drift(events, threshold).writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True)
    started(spark, writer).awaitTermination()
    return spark.read.schema(OUT).parquet(f"{base}/out")


def logged(spark: SparkSession, path: str) -> DataFrame:
    """A stream of the steps in the segments of a log."""
    return spark.readStream.schema(SEEN).json(path).where("pos is not null").select("run_id", "idx", "pos", "step_id", "text")


class LiveObserver:
    """Watches one run: ``observe`` takes a payload, flags go to ``on_flag``, ``report`` analyses all steps.

    Payloads go to an append log that a stream reads, so observing waits for
    nothing, and the driver keeps none of them.  ``observe`` never raises:
    what goes wrong in it, or in the callback, becomes a note.  Without a
    callback a flag is a warning.  With the same ``folder``, a new observer
    goes on where the last one ended: no step is measured and no flag is
    handed on again.  What was observed in the last hundredths of a second
    before a process died is not in the log; ``drain`` waits until all is.
    """

    def __init__(self, spark: SparkSession, threshold: float, on_flag: Callable[[dict], None] | None = None, run_id: str = "live", folder: str | None = None, idle_ms: int = IDLE_MS):
        self.spark, self.run_id, self.notes = spark, run_id, []
        self.folder = folder or f"{shared_dir(spark)}/observed-{uuid.uuid4().hex}"
        self._steps = SharedFolder(spark, f"{self.folder}/steps")
        self._log = StepLog(self._steps)
        self._ledger = Ledger(SharedFolder(spark, f"{self.folder}/flags"))
        self._on_flag = on_flag or (lambda flag: warnings.warn(f"step {flag['step_id']} crossed the drift threshold", stacklevel=2))
        rows = live_drift(logged(spark, self._steps.path), threshold, idle_ms)
        self._query = started(spark, rows.writeStream.foreachBatch(self._batch).option("checkpointLocation", f"{self.folder}/state"))

    def _batch(self, rows: DataFrame, batch: int) -> None:
        self._ledger.hand_on(batch, rows.where("fresh").orderBy("run_id", "idx").toLocalIterator(), self._flag)

    def _flag(self, row) -> None:
        try:
            self._on_flag(row.asDict())
        except Exception as e:
            self.notes.append(f"on_flag failed at step {row['step_id']}: {type(e).__name__}: {e}")

    def observe(self, payload) -> None:
        try:
            pos = self._log.mark
            event = {"run_id": self.run_id, "idx": self._log.offset, "payload": json.dumps(payload, ensure_ascii=False, default=str)}
            if isinstance(payload, dict):  # anything else is no step, but is noted in the report
                text = payload.get("text")
                event |= {"pos": pos, "step_id": str(payload.get("step_id", pos)), "text": text if isinstance(text, str) else ""}
                pos += 1
            self._log.append(json.dumps(event) + "\n", pos)
        except Exception as e:
            self.notes.append(f"observe failed: {type(e).__name__}: {e}")

    def drain(self) -> None:
        """Wait until all that was observed is in the log and has been measured."""
        self._log.flush()
        self._query.processAllAvailable()

    def report(self, **options):
        """(signals, reports) of all steps so far, and the observer's notes."""
        from ..operators.report import analyze

        self.drain()
        rows = self.spark.read.schema(SEEN).json(self._steps.path)
        steps, notes = from_payloads(rows.selectExpr("run_id", "cast(idx as int) idx", "payload"))
        own = self.spark.createDataFrame([(self.run_id, 9, i, "observer", n) for i, n in enumerate(self.notes)], notes.schema)
        return analyze(steps, notes=notes.unionByName(own), **options)

    def close(self) -> None:
        try:
            self._log.close()
        finally:
            self._query.stop()

    def remove(self) -> None:
        """Delete the log, the state and the ledger of a closed observer."""
        SharedFolder(self.spark, self.folder).remove()

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.close()
