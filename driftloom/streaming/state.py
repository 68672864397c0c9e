"""Live drift of runs whose steps arrive one at a time.

What a run needs is kept by key: one value with its last step's word counts,
its anchor's and how far it has come, and a map with an entry for each flagged
step.  The value doesn't grow with the run, an entry is written once and looked
up by its key, and both expire when a run has been idle for long enough.  The
stream computes drift only; all else is the batch analysis of the steps.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: What a stream of steps needs, and what it gives.  ``idx`` is a step's place in its run's order of arrival.
EVENTS = ("run_id", "idx", "pos", "step_id", "text")
OUT = "run_id string, idx long, pos int, step_id string, ordinal int, drift_prev double, drift_anchor double, flagged boolean, fresh boolean, note string"
#: How long an idle run is remembered unless told otherwise.
IDLE_MS = 7 * 24 * 3600 * 1000
_BLANK = re.compile(r"\s*\Z")
_WORD = re.compile(r"[^ \t\n\x0b\f\r]+")


def _counts(text: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for w in _WORD.findall(text.lower()):
        out[w] = out.get(w, 0) + 1
    return out


def _drift(a: dict, b: dict) -> float:
    norms = sum(x * x for x in a.values()) ** 0.5 * sum(x * x for x in b.values()) ** 0.5
    return 1 - (sum(n * b.get(w, 0) for w, n in a.items()) / norms if norms else 0.0)


def step_through(known: dict | None, rows: list[tuple], threshold: float, first_flag: Callable[[str], bool]) -> tuple[dict, list[tuple]]:
    """The state after some steps (idx, pos, step_id, text) in order of arrival, and a row for each.

    A step whose pos is not beyond the last is late, and one without text is
    skipped: both are noted, not measured.  ``first_flag`` is told of a flagged
    step's id and returns whether it is flagged for the first time.
    """
    state = known or {"pos": -1, "ordinal": -1, "prev": None, "anchor": None}
    out = []
    for idx, pos, step_id, text in rows:
        if pos <= state["pos"]:
            out.append((idx, pos, step_id, None, None, None, False, False, f"step {step_id} at position {pos} came late"))
            continue
        state["pos"] = pos
        if not isinstance(text, str) or _BLANK.match(text):
            out.append((idx, pos, step_id, None, None, None, False, False, f"step {step_id} skipped: empty or non-text content"))
            continue
        own = _counts(text)
        state["ordinal"] += 1
        if state["anchor"] is None:
            prev = anchor = None
            state["anchor"] = own
        else:
            prev, anchor = _drift(own, state["prev"]), _drift(own, state["anchor"])
        state["prev"] = own
        flagged = anchor is not None and (prev > threshold or anchor > threshold)
        out.append((idx, pos, step_id, state["ordinal"], prev, anchor, flagged, flagged and first_flag(step_id), None))
    return state, out


class DriftProcessor(StatefulProcessor):
    """``step_through`` for each run of a stream."""

    def __init__(self, threshold: float, idle_ms: int):
        self._threshold, self._idle_ms = threshold, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._last = handle.getValueState("last", "state string", self._idle_ms)
        self._flagged = handle.getMapState("flagged", "step_id string", "seen boolean", self._idle_ms)

    def handleInputRows(self, key, rows: Iterator, timerValues) -> Iterator:
        import pandas as pd

        arrived = sorted((int(i), int(p), s, t) for f in rows for i, p, s, t in zip(f["idx"], f["pos"], f["step_id"], f["text"]))
        known = json.loads(self._last.get()[0]) if self._last.exists() else None
        known, out = step_through(known, arrived, self._threshold, self._first)
        self._last.update((json.dumps(known),))
        frame = pd.DataFrame([(key[0], *r) for r in out], columns=["run_id", "idx", "pos", "step_id", "ordinal", "drift_prev", "drift_anchor", "flagged", "fresh", "note"])
        yield frame.astype({"ordinal": "Int32", "drift_prev": "Float64", "drift_anchor": "Float64"})

    def _first(self, step_id: str) -> bool:
        if self._flagged.containsKey((step_id,)):
            return False
        self._flagged.updateValue((step_id,), (True,))
        return True

    def close(self) -> None:
        pass


def live_drift(events: DataFrame, threshold: float, idle_ms: int = IDLE_MS) -> DataFrame:
    """A row for each event (run_id, idx, pos, step_id, text) of a stream; its state needs the RocksDB store."""
    own = events.selectExpr("run_id", "cast(idx as long) idx", "cast(pos as int) pos", "step_id", "text")
    return own.groupBy("run_id").transformWithStateInPandas(DriftProcessor(threshold, idle_ms), OUT, "append", "processingTime")
