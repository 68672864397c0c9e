import re
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from driftloom.llm import common
from tests.llm import plain
from tests.llm.test_nearset import brute


def written(spark, path, docs, bench, kind="doc_id long, text string, lang string, source string, n_chars long"):
    spark.createDataFrame(docs, kind).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return spark.read.parquet(f"{path}/documents.parquet")


def test_stages_equal_plain_versions(spark, tmp_path):
    docs, bench = plain.corpus()
    long = max(docs, key=lambda d: len(d[1] or ""))
    near = " ".join(["changed", *long[1].split()[1:]])  # one word of many: similar, not equal
    docs.append((600, near, "aa", "s1", len(near)))
    frame = written(spark, tmp_path, docs, bench)
    columns = frame.columns
    held = {}
    for name, stage in corpus_pipeline.STAGES:
        frame = stage(spark, frame, str(tmp_path))
        held[name] = frame.collect()
        if name != corpus_pipeline.STAGES[-1][0]:
            assert frame.columns == columns, name
        frame = spark.createDataFrame(held[name], frame.schema)
    have = {d[0]: d for d in docs}
    want = {i for i, d in have.items() if d[1] and re.search(r"[^\W\d_]", d[1])}
    assert {r.doc_id for r in held["language_id"]} == want
    first, _ = brute({i: have[i][1] for i in want})
    want = {i for i in want if first[i] == i}
    assert {r.doc_id for r in held["near_dedup"]} == want and 600 not in want
    want = {i for i in want if not any(plain.contaminated(have[i][1], b) for _, b in bench)}
    assert {r.doc_id for r in held["decontamination"]} == want
    assert {r.doc_id: r.text for r in held["redaction"]} == {i: plain.redacted(have[i][1]) for i in want}
    assert all(r.n_chars == len(r.text) for r in held["redaction"])
    sizes, taken = defaultdict(int), Counter()
    for r in held["redaction"]:
        sizes[r.source] += len(r.text.split())
    of = {r.doc_id: r for r in held["redaction"]}
    for r in held["mixture"]:
        taken[r.source] += r.taken
        assert r.doc_id in want and r.source_size == sizes[r.source] and 0 < r.taken <= 3 * r.size
        assert [r[c] for c in columns] == [of[r.doc_id][c] for c in columns] and sum(d.words for d in r.draws) == r.taken
    assert abs(sum(taken.values()) - sum(sizes.values())) <= len(sizes)  # targets are rounded
    ran = corpus_pipeline.run(spark, str(tmp_path))
    assert ran.columns == [*columns, "size", "source_size", "target", "taken", "draws"]
    assert sorted((r.doc_id, r.taken, r.text) for r in ran.collect()) == sorted((r.doc_id, r.taken, r.text) for r in held["mixture"])


def test_odd_rows_and_columns(spark, tmp_path):
    """Nulls in all columns, a repeated row, a long text, ties, and columns that have names of the stages' own."""
    kind = "doc_id long, text string, lang string, source string, n_chars int, taken string, mark int, `x.y` string, kind string"
    tail = ("t", 1, "dot", "k")
    long = "word " * 60_000 + "mail a.b@c.org"
    docs = [
        (1, "the house by the river is old", "en", "s", 5, *tail), (1, "the house by the river is old", "en", "s", 5, *tail), (2, long, "en", None, None, *tail),
        (None, "a text without an id has words", None, "s", 0, None, None, None, None), (3, None, "en", "s", 0, *tail), (4, "", None, None, None, *tail),
        (5, "das haus am fluss ist alt und klein", "de", "s", 3, *tail), (6, "das haus am fluss ist alt und klein", "de", "q", 3, *tail), (7, "7 8 9", "de", "q", 3, *tail),
    ]
    frame = written(spark, tmp_path, docs, [(1, None), (None, "x y z")], kind)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        frame = common.cut(stage(spark, frame, str(tmp_path)), name)
        assert frame.columns == [c.split()[0].strip("`") for c in kind.split(", ")], name
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {"taken", "taken_mix", "x.y", "mark", "kind"} <= set(rows[0].__fields__)
    kept = Counter(r.doc_id for r in frame.collect())
    assert kept == {1: 2, 2: 1, None: 1, 5: 1}
    assert {r.doc_id for r in rows} <= set(kept) and all(r["x.y"] == "dot" for r in rows if r.doc_id)
    assert all(r.text.endswith("mail [EMAIL]") and r.n_chars is not None for r in rows if r.doc_id == 2)


def test_empty_tables(spark, tmp_path):
    written(spark, tmp_path, [], [])
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_no_language_to_learn_from(spark, tmp_path):
    frame = written(spark, tmp_path, [(1, "words", None, "s", 5), (2, "12", None, "s", 2)], [])
    assert [r.doc_id for r in corpus_pipeline.language_id(spark, frame, str(tmp_path)).collect()] == [1]


def test_intermediate_tables_go(spark, tmp_path):
    import os

    since = common.made()
    paths = [common.cut(spark.range(n), "t").inputFiles()[0].removeprefix("file://") for n in (1, 2, 3)]
    common.drop(spark, since, keep=1)
    assert [os.path.exists(p) for p in paths] == [False, False, True] and common.made() == since + 1


def test_a_cluster_must_name_its_folder(monkeypatch):
    from types import SimpleNamespace as Some

    def session(master, conf=None, given=None):
        option = Some(isDefined=lambda: given is not None, get=lambda: given)
        return Some(conf=Some(get=lambda *_: conf), sparkContext=Some(master=master, _jsc=Some(sc=lambda: Some(getCheckpointDir=lambda: option))))

    for master in ("spark://host", "local-cluster[2,1,1024]", "yarn"):
        with pytest.raises(RuntimeError):
            common.shared_dir(session(master))
    assert common.shared_dir(session("yarn", "hdfs://a")) == "hdfs://a" and common.shared_dir(session("yarn", None, "hdfs://b")) == "hdfs://b"
    assert common.shared_dir(session("local[4]")).startswith("file://")
