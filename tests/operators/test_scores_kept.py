import pytest
from pyspark.sql import functions as F

from driftloom.operators import drift, models, scorers
from driftloom.operators.steps import densified

KIND = "run_id string, pos int, step_id string, agent_name string, role string, text string"


def frame(spark, texts):
    return densified(spark.createDataFrame([("r", i, str(i), None, None, t) for i, t in enumerate(texts)], KIND))


def embedder(log, fail=()):
    def load():
        def call(texts):
            if any(t in fail for t in texts):
                raise ValueError("no")
            with open(log, "a") as f:
                f.writelines(f"{t}\n" for t in texts)
            return [[float(len(t)), 1.0] for t in texts]

        return call

    return load


def test_only_what_the_table_lacks_is_scored(spark, tmp_path):
    table = lambda model: scorers.ScoreTable(spark, f"file://{tmp_path}/scores", model)
    told = lambda: sorted((tmp_path / "calls").read_text().split()) if (tmp_path / "calls").exists() else []
    run = lambda texts, model="m", fail=(): sorted((r.text, r.vector, r.error) for r in scorers.embed_with(frame(spark, texts), "text", embedder(tmp_path / "calls", fail), table(model)).collect())
    assert run(["a", "bb", "a"]) == [("a", [1.0, 1.0], None), ("a", [1.0, 1.0], None), ("bb", [2.0, 1.0], None)] and told() == ["a", "bb"]
    assert run(["bb", "a"])[1] == ("bb", [2.0, 1.0], None) and told() == ["a", "bb"]
    assert [r[2] for r in run(["a", "ccc", "bad"], fail=("bad",))] == [None, "ValueError: no", None] and told() == ["a", "bb", "ccc"]
    assert run(["bad"])[0][1:] == ([3.0, 1.0], None) and told() == ["a", "bad", "bb", "ccc"]  # a failure is tried again
    run(["a"], "another model")
    assert told().count("a") == 2


def test_nothing_to_score_and_all_failed(spark, tmp_path):
    table = scorers.ScoreTable(spark, f"file://{tmp_path}/scores", "m")
    load = embedder(tmp_path / "calls", ("x",))
    assert scorers.embed_with(frame(spark, []), "text", load, table).collect() == []
    assert [r.error for r in scorers.embed_with(frame(spark, ["x"]), "text", load, table).collect()] == ["ValueError: no"]


def test_pairs_are_kept_apart_by_their_parts(spark, tmp_path):
    table = scorers.ScoreTable(spark, f"file://{tmp_path}/scores", "m")
    rows = spark.createDataFrame([("a", "bc"), ("ab", "c")], "p string, h string")
    load = lambda: lambda pairs: [(len(p) / 10, len(h) / 10, 0.0) for p, h in pairs]
    for _ in range(2):
        assert sorted((r.p, r.entailment, r.neutral) for r in scorers.judge_with(rows, "p", "h", load, table).collect()) == [("a", 0.1, 0.2), ("ab", 0.2, 0.1)]


def test_models_take_tables(spark, tmp_path):
    own = spark.createDataFrame([("r", i, str(i), None, None, t) for i, t in enumerate(["aa", "b", "aa"])], KIND)
    anchors = spark.createDataFrame([("r", "list", ["aa", "q"])], "run_id string, kind string, texts array<string>")
    judge = lambda: lambda pairs: [(0.9, 0.05, 0.05)] * len(pairs)
    seen = []
    for _ in range(2):
        tables = {k: scorers.ScoreTable(spark, f"file://{tmp_path}/t", k) for k in ("embedded", "judgements")}
        out = models.scores(own, embedder(tmp_path / "calls"), judge, anchors, **tables)
        seen.append(sorted(map(tuple, out["drift"].collect())) + sorted(map(tuple, out["covered"].collect())))
    assert seen[0] == seen[1] and sorted((tmp_path / "calls").read_text().split()) == ["aa", "b", "q"]


def test_mean_vectors(spark):
    rows = [("a", [1.0, 2.0]), ("a", [3.0, None]), ("a", None), ("b", [1.0]), ("b", [2.0, 8.0]), ("c", None), (None, [4.0]), ("d", [])]
    got = {r.run_id: r.anchor for r in drift.consensus(spark.createDataFrame(rows, "g string, v array<double>").repartition(3), "g", "v").collect()}
    assert got == {"a": [2.0, 2.0], "b": [1.5, 8.0], None: [4.0], "d": []}
    wide = spark.range(5000).select((F.col("id") % 3).alias("g"), F.array(*[(F.col("id") * k).cast("float") for k in range(50)]).alias("v")).repartition(8)
    got = {r.run_id: r.anchor for r in drift.consensus(wide, "g", "v").collect()}
    want = {str(g): sum(range(g, 5000, 3)) / len(range(g, 5000, 3)) for g in range(3)}
    assert all(got[g] == pytest.approx([m * k for k in range(50)]) for g, m in want.items())
    plan = drift.consensus(wide, "g", "v")._jdf.queryExecution().toString()
    assert "Generate" not in plan


def test_sums_of_many_runs_are_given_on_and_added_later(spark, monkeypatch):
    monkeypatch.setattr(drift._added, "__defaults__", (2,))
    rows = [(str(i % 7), [float(i)]) for i in range(100)]
    got = {r.run_id: r.anchor[0] for r in drift.consensus(spark.createDataFrame(rows, "g string, v array<double>").coalesce(1), "g", "v").groupBy("run_id").agg(F.first("anchor").alias("anchor"), F.count("anchor").alias("n")).where("n >= 1").collect()}
    assert set(got) == set("0123456")
