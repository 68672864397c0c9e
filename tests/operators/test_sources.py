"""Reading, writing, live observation and the command line."""

import json
from types import SimpleNamespace

import pytest

from driftloom import cli
from driftloom.operators import report
from driftloom.sources import ingest, sinks
from driftloom.sources.callbacks import ChainRecorder


def test_permissive_reading(spark):
    payloads = [
        {"step_id": 7, "text": "a", "agent_name": "x", "role": "tool", "extra": 1, "metadata": {"k": 1, "extra": 0}}, "no object", {"text": 5, "step_id": "s"}, {"step_id": 3},
        {"text": "b", "metadata": [1]}, None, {"text": None, "step_id": None},
    ]
    steps, notes = ingest.from_lists(spark, {"r": payloads})
    rows = steps.orderBy("pos").collect()
    assert [(r.pos, r.step_id, r.text) for r in rows] == [(0, "7", "a"), (1, "s", ""), (2, "3", ""), (3, "3", "b"), (4, None, "")]
    told = {(r.pos, r.code) for r in notes.collect()}
    assert told == {(1, "not_an_object"), (1, "text_not_string"), (2, "no_text"), (3, "no_step_id"), (3, "odd_metadata"), (4, "not_an_object"), (4, "text_not_string")}
    shown = steps.selectExpr("pos", "to_json(metadata) j").orderBy("pos").collect()
    assert json.loads(shown[0].j) == {"k": 1, "extra": 1} and json.loads(shown[3].j) == {"metadata": [1]}


def test_files_and_folders(spark, tmp_path):
    (tmp_path / "one.json").write_text(json.dumps([{"step_id": 1, "text": "é a"}, {"step_id": 2, "text": "b"}]))
    (tmp_path / "two.JSONL").write_text('{"text": "c"}\n\n{"text": "d"}\nnot json\n{"text": "e"}\n')
    (tmp_path / "other.txt").write_text("x")
    steps, notes = ingest.read_files(spark, str(tmp_path))
    rows = {(r.run_id.rsplit("/", 1)[1], r.pos): r.text for r in steps.collect()}
    assert rows == {("one.json", 0): "é a", ("one.json", 1): "b", ("two.JSONL", 0): "c", ("two.JSONL", 1): "d", ("two.JSONL", 2): "e"}
    assert notes.where("code = 'not_an_object'").count() == 1
    (tmp_path / "bad.json").write_text('{"no": "array"}')
    with pytest.raises(Exception, match="not a JSON array"):
        ingest.read_files(spark, f"{tmp_path}/bad.json")[0].collect()


def test_reports_are_written(spark, tmp_path):
    steps, notes = ingest.from_lists(spark, {"r": [{"text": "a b"}, {"text": "c d"}, {"text": ""}]})
    _, reports = report.analyze(steps, notes=notes)
    one = reports.first()
    text = sinks.report_text(one)
    assert "verdict: True" in text and "drift_anchor=" in text and "skipped" in text and "thresholds: profile=" in text
    assert "attribution:\n  1. " in text and "monitoring_failure: -" in text
    assert json.loads(sinks.report_json(one))["verdict"] is True
    assert json.loads(sinks.as_json(reports).first().report)["steps"][0]["drift_prev"] is None
    sinks.write_json(reports, f"{tmp_path}/out")
    assert spark.read.json(f"{tmp_path}/out").count() == 1
    sinks.export_splits(f"{tmp_path}/data", clean=steps.select("run_id", "text"))
    assert spark.read.json(f"{tmp_path}/data/clean").count() == 3


def test_recorder_never_breaks_the_chain():
    seen = []
    recorder = ChainRecorder(seen.append)
    recorder.on_llm_end(SimpleNamespace(generations=[[SimpleNamespace(text="a"), SimpleNamespace(text="")], [SimpleNamespace(text="b")]]), name="n")
    recorder.on_chain_end({"x": "c", "y": 3, "z": "d"})
    recorder.on_tool_end("  ")
    recorder.on_tool_end(42)
    recorder.on_llm_end(None)
    ChainRecorder(lambda step: 1 / 0).on_tool_end("x")
    assert [(s["step_id"], s["text"], s["role"]) for s in seen] == [(1, "a b", "llm"), (2, "c d", "chain"), (3, "42", "tool")]


def test_command_line(spark, tmp_path, capsys):
    calm, wild = tmp_path / "calm.json", tmp_path / "wild.jsonl"
    calm.write_text(json.dumps([{"step_id": i, "text": "the same text again"} for i in range(3)]))
    wild.write_text("\n".join(json.dumps({"step_id": i, "text": t}) for i, t in enumerate(["a b c", "a b d", "x y z"])))
    assert cli.main(["analyze", str(calm), "--threshold", "0.5"], spark) == 0
    assert cli.main(["analyze", str(wild), "--json-out", f"{tmp_path}/r.json", "--anchor", "a b c. And more of it all here."], spark) == 1
    assert json.loads((tmp_path / "r.json").read_text())["verdict"] is True
    assert "CASCADE" in capsys.readouterr().out
    (tmp_path / "bad.json").write_text("{")
    assert cli.main(["analyze", f"{tmp_path}/bad.json"], spark) == 2
    assert cli.main(["analyze", f"{tmp_path}/missing.json"], spark) == 2
    runs = tmp_path / "clean"
    runs.mkdir()
    assert cli.main(["calibrate", str(runs)], spark) == 2
    for i in range(3):
        (runs / f"{i}.json").write_text(json.dumps([{"text": "a b c"}, {"text": f"a b {i}"}]))
    assert cli.main(["calibrate", str(runs), "--percentile", "90", "--save", f"{tmp_path}/p.json", "--name", "mine"], spark) == 0
    assert json.loads((tmp_path / "p.json").read_text())["name"] == "mine"
