import json

import pytest

from driftloom.operators.report import analyze
from driftloom.sources.folder import GrowingFolder
from driftloom.streaming.reports import ReportTable, report_new


def test_each_run_has_one_report(spark, tmp_path, monkeypatch):
    runs = tmp_path / "runs"
    runs.mkdir()
    put = lambda name, *texts: (runs / name).write_text(json.dumps([{"text": t} for t in texts]))
    shown = lambda t: sorted((r.run_id.rsplit("/", 1)[1], r.verdict) for r in t.rows.collect())
    folder, table = GrowingFolder(spark, f"file://{runs}", f"file://{tmp_path}/base", files=1), ReportTable(spark, f"file://{tmp_path}/reports")
    assert table.rows is None and report_new(folder, table) == 0
    put("a.json", "a b c", "x y z")
    put("b.json", "a b c", "a b c")
    (runs / "bad.json").write_text("{")
    folder.take_in()
    assert report_new(folder, table) == 3 and report_new(folder, table) == 0
    assert shown(table) == [("a.json", True), ("b.json", False)]

    # The process dies when rows are written and not entered.
    put("c.json", "k l m", "n o p")
    folder.take_in()
    with monkeypatch.context() as m:
        m.setattr(table._ledger, "write", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            report_new(folder, table)
    assert shown(table) == [("a.json", True), ("b.json", False)]
    again = ReportTable(spark, table.base)
    assert report_new(GrowingFolder(spark, folder.path, folder.base), again) == 1
    assert shown(again) == [("a.json", True), ("b.json", False), ("c.json", True)]
    _, whole = analyze(folder.steps, notes=folder.notes.where("code <> 'unreadable'"))
    one = lambda rows: sorted(json.dumps(r.asDict(True), sort_keys=True) for r in rows.collect())
    assert one(again.rows) == one(whole)


def test_a_batch_is_entered_once(spark, tmp_path):
    table, rows = ReportTable(spark, f"file://{tmp_path}/t"), spark.createDataFrame([("r", 1)], "run_id string, n int")
    assert table.enter(7, rows) and not table.enter(7, rows.union(rows)) and table.rows.count() == 1
