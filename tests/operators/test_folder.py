import json

from driftloom.operators.report import analyze
from driftloom.sources.folder import GrowingFolder


def test_a_growing_folder_is_read_once(spark, tmp_path):
    runs = tmp_path / "runs"
    runs.mkdir()
    folder = GrowingFolder(spark, f"file://{runs}", f"file://{tmp_path}/base", files=2)
    rows = lambda: sorted((r.run_id.rsplit("/", 1)[1], r.pos, r.text) for r in folder.steps.collect())
    put = lambda name, text: (runs / name).write_text(text)
    put("a.json", json.dumps([{"text": "one"}, 5, {"text": "two"}]))
    put("b.json", '[{"text": "cut o')
    put("c.jsonl", '{"text": "x"}\nnot json\n{"text": "y"}\n')
    put("d.txt", "no run")
    put("e.JSON", "")
    folder.take_in()
    first = [("a.json", 0, "one"), ("a.json", 1, "two"), ("c.jsonl", 0, "x"), ("c.jsonl", 1, "y")]
    assert rows() == first
    folder.take_in()
    assert rows() == first
    put("f.json", json.dumps([{"text": "new"}]))
    put("g.json", '{"no": "array"}')
    GrowingFolder(spark, folder.path, folder.base).take_in()
    assert rows() == [*first, ("f.json", 0, "new")]
    aside = sorted(r.run_id.rsplit("/", 1)[1] for r in folder.notes.where("code = 'unreadable'").collect())
    assert aside == ["b.json", "e.JSON", "g.json"] or aside == ["b.json", "g.json"]  # an empty file has no row
    assert folder.notes.where("code = 'not_an_object'").count() == 2
    _, reports = analyze(folder.steps.selectExpr("run_id", "pos", "step_id", "agent_name", "role", "text"), notes=folder.notes)
    assert reports.count() == 3


def test_a_batch_that_runs_again_writes_the_same(spark, tmp_path):
    folder = GrowingFolder(spark, "unused", f"file://{tmp_path}/base")
    texts = spark.createDataFrame([("a.json", '[{"text": "t"}]'), ("b.json", None)], "run_id string, value string")
    for _ in range(2):
        folder._batch(texts, 0)
    assert folder.steps.count() == 1 and folder.notes.where("code = 'unreadable'").count() == 1
