import json
import random
import time
import warnings

import pytest
from pyspark.sql import functions as F

from driftloom.operators import drift
from driftloom.operators.steps import densified
from driftloom.streaming import log, observer, state


def through(rows, cut, threshold=0.3):
    """The rows of one run, its state written and read between batches of ``cut``."""
    known, seen, out, sizes = None, set(), [], []

    def first(step_id):
        new = step_id not in seen
        seen.add(step_id)
        return new

    for a in range(0, len(rows), cut):
        known, got = state.step_through(json.loads(json.dumps(known)), rows[a : a + cut], threshold, first)
        out += got
        sizes.append(len(json.dumps(known)))
    return out, sizes


def test_stream_equals_batch_however_it_is_cut(spark):
    rng = random.Random(3)
    rows = [(f"r{r}", p, str(p % 3), rng.choice(["a b c", "a b", "", "x y", "b c d"])) for r in range(4) for p in range(8)]
    kind = "run_id string, pos int, step_id string, text string, agent_name string, role string"
    batch = {(r.run_id, r.ordinal): (r.drift_prev, r.drift_anchor) for r in drift.bag_drift(densified(spark.createDataFrame([(*r, None, None) for r in rows], kind))).collect()}
    for cut in (1, 3, 8):
        got = {}
        for run in {r[0] for r in rows}:
            out, _ = through([(p, p, s, t) for r, p, s, t in rows if r == run], cut)
            got |= {(run, o[3]): (o[4], o[5]) for o in out if o[3] is not None}
        assert got.keys() == batch.keys()
        for k, v in got.items():
            assert v == pytest.approx(batch[k])


def test_late_skipped_and_repeated_steps():
    rows = [(0, 0, "a", "x"), (1, 1, "a", "y"), (2, 4, "a", "z"), (3, 2, "b", "late"), (4, 5, "c", " \n"), (5, 6, "d", None), (6, 7, "e", "w")]
    out, _ = through(rows, 2)
    assert [(o[3], o[6], o[7]) for o in out] == [(0, False, False), (1, True, True), (2, True, False), (None, False, False), (None, False, False), (None, False, False), (3, True, True)]
    assert [bool(o[8]) for o in out] == [False, False, False, True, True, True, False] and "came late" in out[3][8]


def test_state_doesnt_grow_with_the_run():
    rows = [(i, i, f"step {i}", f"alpha {i % 10} beta") for i in range(10_000)]
    out, sizes = through(rows, 100)
    assert all(o[7] for o in out[1:] if o[6]) and sizes[0] <= max(sizes) <= sizes[0] + 6


def events(spark, rows, path):
    spark.createDataFrame(rows, "run_id string, idx long, pos int, step_id string, text string").coalesce(1).write.mode("append").json(path)


def test_flags_stay_over_batches_and_go_when_a_run_idles(spark, tmp_path):
    """Each call below is a stream of its own that takes up the state of the one before."""
    path, base = f"{tmp_path}/in", f"{tmp_path}/state"

    def batch(rows, idle_ms):
        events(spark, rows, path)
        stream = spark.readStream.schema("run_id string, idx long, pos int, step_id string, text string").json(path)
        writer = state.live_drift(stream, 0.3, idle_ms).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", base).trigger(availableNow=True)
        observer.started(spark, writer).awaitTermination()
        return {(r.run_id, r.idx): (r.ordinal, r.fresh, r.note is not None) for r in spark.read.parquet(f"{tmp_path}/out").collect()}

    long = 3600_000
    assert batch([("r", 0, 0, "a", "x"), ("r", 1, 1, "b", "y")], long)[("r", 1)] == (1, True, False)
    got = batch([("r", 2, 2, "b", "z"), ("r", 3, 1, "q", "x"), ("s", 0, 0, "a", "x")], long)
    assert got[("r", 2)] == (2, False, False) and got[("r", 3)] == (None, False, True) and got[("s", 0)] == (0, False, False)


def test_an_idle_run_is_forgotten(spark, tmp_path):
    path = f"{tmp_path}/in"
    stream = lambda: spark.readStream.schema("run_id string, idx long, pos int, step_id string, text string").json(path)
    for i in range(2):
        events(spark, [("r", i, 0, "a", "x")], path)
        writer = state.live_drift(stream(), 0.3, 1000).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True)
        observer.started(spark, writer).awaitTermination()
        time.sleep(1.5)
    assert sorted((r.idx, r.ordinal) for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [(0, 0), (1, 0)]


def test_log_has_few_segments_and_goes_on(spark, tmp_path):
    folder = log.SharedFolder(spark, f"{tmp_path}/log")
    steps = log.StepLog(folder)
    waits = []
    for i in range(5000):
        began = time.perf_counter()
        assert steps.append(f'{{"n": {i}}}\n', i * 2) == i
        waits.append(time.perf_counter() - began)
    steps.close()
    assert sorted(waits)[2500] < 1e-4 and len(folder.names()) < 100
    again = log.StepLog(folder)
    assert (again.offset, again.mark) == (5000, 9998)
    again.append('{"n": 5000}\n', 0)
    again.flush()
    again.close()
    with pytest.raises(RuntimeError):
        again.append("x", 0)
    got = spark.read.json(folder.path)
    assert got.count() == got.distinct().count() == 5001
    folder.remove()
    assert not (tmp_path / "log").exists()


def test_log_keeps_lines_in_order_while_the_folder_fails(spark, tmp_path):
    folder = log.SharedFolder(spark, f"{tmp_path}/log")
    write, fails = folder.write, [3]

    def shaky(name, text):
        if fails[0]:
            fails[0] -= 1
            raise OSError("no space")
        write(name, text)

    folder.write = shaky
    steps = log.StepLog(folder)
    for i in range(10):
        steps.append(f"{i}\n", 0)
        time.sleep(0.02)
    steps.close()
    assert "".join((tmp_path / "log" / n).read_text() for n in folder.names()) == "".join(f"{i}\n" for i in range(10))


def test_ledger_hands_on_the_rest_after_a_break(spark, tmp_path):
    ledger, got = log.Ledger(log.SharedFolder(spark, f"{tmp_path}/ledger")), []

    def breaks(item):
        if item == 3:
            raise KeyboardInterrupt
        got.append(item)

    with pytest.raises(KeyboardInterrupt):
        ledger.hand_on(0, range(6), breaks)
    ledger.hand_on(0, range(6), got.append)
    ledger.hand_on(0, range(6), got.append)  # the stream's commit was lost
    ledger.hand_on(1, [], got.append)
    ledger.hand_on(2, [9], got.append)
    assert got == [0, 1, 2, 3, 4, 5, 9]


def test_live_observer_and_its_restart(spark, tmp_path):
    seen = []

    def on_flag(flag):
        seen.append(flag["step_id"])
        raise RuntimeError("callback broke")

    class Odd:
        def __str__(self):
            raise ValueError("can't be written")

    with observer.LiveObserver(spark, 0.5, on_flag, folder=f"{tmp_path}/o") as live:
        for payload in ({"step_id": 1, "text": "a b"}, {"step_id": 2, "text": "a b"}, "garbage", {"step_id": 3, "text": "q r"}, {"x": Odd()}):
            live.observe(payload)
        _, reports = live.report()
        one = reports.first()
    assert seen == ["3"] and one.verdict and len(one.steps) == 3
    assert any("callback broke" in n for n in one.notes) and any("not an object" in n for n in one.notes) and any("observe failed" in n for n in one.notes)
    with observer.LiveObserver(spark, 0.5, on_flag, folder=f"{tmp_path}/o") as live:
        live.observe({"step_id": 3, "text": "a b"})  # flagged before
        live.observe({"step_id": 4, "text": "a b"})
        live.observe({"text": "z z"})
        _, reports = live.report()
        one = reports.first()
    assert seen == ["3", "5"] and [s.step_id for s in one.steps] == ["1", "2", "3", "3", "4", "5"]
    live.remove()


def test_a_flag_without_a_callback_is_a_warning():
    with warnings.catch_warnings(record=True) as told:
        warnings.simplefilter("always")
        live = object.__new__(observer.LiveObserver)
        live.notes = []
        live._on_flag = lambda flag: warnings.warn(f"step {flag['step_id']} crossed the drift threshold", stacklevel=2)
        live._flag(type("Row", (), {"asDict": lambda self: {"step_id": "7"}})())
    assert "step 7" in str(told[0].message)


def test_the_session_keeps_its_own_settings(spark, tmp_path):
    before = {k: spark.conf.get(k, None) for k in observer.SETTINGS}
    events(spark, [("r", 0, 0, "a", "x")], f"{tmp_path}/in")
    stream = spark.readStream.schema("run_id string, idx long, pos int, step_id string, text string").json(f"{tmp_path}/in")
    rows = observer.replay(spark, stream.where(F.lit(True)), 0.3)
    assert rows.count() == 1 and {k: spark.conf.get(k, None) for k in observer.SETTINGS} == before
