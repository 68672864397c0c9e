import json

import pytest

from driftloom.sources import arrays
from driftloom.sources.arrays import elements, read_arrays
from driftloom.sources.ingest import read_files

STEPS = [
    {"step_id": 1, "text": 'a, "quoted, [text" and \\, {more}', "metadata": {"k": [1, {"x": "]},["}]}}, 5, {"text": "é, ü,, 𝄞"}, [1, [2, 3]], {"text": "", "role": "tool"}, None,
    {"step_id": "s", "text": 'ends in \\'}, {"step_id": "t", "text": ',"},{"', "metadata": {}}, {"text": "x"},
]


def rows_of(steps):
    return sorted((r.run_id.rsplit("/", 1)[1], r.pos, r.step_id or "", r.text, r.role or "", r.meta) for r in steps.selectExpr("run_id", "pos", "step_id", "text", "role", "to_json(metadata) meta").collect())


@pytest.mark.parametrize("size, power", [(1, 15), (17, 1), (1 << 20, 0), (1 << 20, 15)])
def test_blocks_of_any_size_give_the_same_rows(spark, tmp_path, monkeypatch, size, power):
    monkeypatch.setattr(arrays, "PIECES", power)
    (tmp_path / "one.json").write_text(json.dumps(STEPS, ensure_ascii=False))
    (tmp_path / "two.json").write_text(json.dumps(STEPS[:3], indent=1))
    (tmp_path / "none.json").write_text(" [ ]\n")
    path = f"file://{tmp_path}"
    steps, notes = read_files(spark, path)
    want, told = rows_of(steps), sorted((r.pos, r.code) for r in notes.collect())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    try:
        steps, notes = read_arrays(spark, path)
        assert rows_of(steps) == want
        assert sorted((r.pos, r.code) for r in notes.collect()) == told
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def pieces(spark, texts, size=2):
    rows = [(run, n // size, n, value) for run, text in texts.items() for n, value in enumerate(text.split(","))]
    return spark.createDataFrame(rows, "run_id string, block int, place int, value string")


def test_other_texts(spark):
    got = elements(pieces(spark, {"a": "[]", "b": "[1]", "c": "[\n[1,2],\n{}]\n", "d": '["]",",,,"]'})).collect()
    assert sorted((r.run_id, r.idx, json.loads(r.payload)) for r in got) == [("b", 0, 1), ("c", 0, [1, 2]), ("c", 1, {}), ("d", 0, "]"), ("d", 1, ",,,")]
    assert elements(pieces(spark, {"a": "[1,2]"}).where("false")).count() == 0


@pytest.mark.parametrize("text", ["", "{}", "[1", "[1,2", "1,2]", "[1,]", "[,]", "[1,2]]", "[1],[2]", "[1] [2]", '[{"a":1]', '["a,b]', "[[1,2]", '{"a":[1,2]}'])
def test_no_array(spark, text):
    with pytest.raises(Exception, match="not a JSON array"):
        elements(pieces(spark, {"r": text})).collect()
