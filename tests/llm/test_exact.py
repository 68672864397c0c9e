import hashlib

from driftloom.llm import exact
from driftloom.llm.queries import op4_fingerprints

KIND = "doc_id long, text string, canon int"


def by_id(rows):
    return {r.doc_id: r for r in rows}


def test_folding(spark):
    same = ["Straße  ＡＢＣ\tx", " strasse abc X ", "STRASSE \n abc x", "strasse abc x"]
    rows = [(i, t, 0) for i, t in enumerate(same)] + [(10, "é", 0), (11, "É", 0), (12, "e", 0), (13, None, 0), (14, "", 0), (15, "  ", 0)]
    got = by_id(exact.fingerprints(spark.createDataFrame(rows, KIND)).collect())
    assert len({got[i].fingerprint for i in range(4)}) == 1
    assert got[10].fingerprint == got[11].fingerprint != got[12].fingerprint
    assert got[13].fingerprint == got[14].fingerprint == got[15].fingerprint
    canon = spark.createDataFrame(rows, KIND).select(exact.canonical(exact.F.col("text")).alias("canon"))
    held = canon.select(exact.wide_hash(exact.F.col("canon")).alias("hash"), exact.F.sha2("canon", 256).alias("sha"), "canon")
    found = exact.groups(held).collect()
    assert sorted(r.rows for r in found) == [1, 2, 3, 4] and all(r.one for r in found)
    assert exact.collided(held, held.select("hash")).count() == 0


def test_edits_equal_brute_force(spark, monkeypatch):
    rows = [(i * 3 - 50, ("é%d😀 " % i) * (i % 7) + "x" * (i % 5), 0) for i in range(9000)]
    rows[77] = (rows[77][0], None, 0)
    rows[78] = (rows[78][0], "L" * 200_000, 0)
    docs = spark.createDataFrame(rows, KIND).repartition(5)
    got = by_id(exact.fingerprints(docs).collect())
    texts = [t or "" for _, t, _ in rows]
    for i, (d, t, _) in enumerate(rows):
        t, n = texts[i], texts[(i + 1) % len(rows)]
        k = len(t) // 4
        e = t[: len(t) - k] + n[:k]
        assert got[d].n_chars == len(t)
        assert got[d].edited_sha256 == hashlib.sha256(e.encode()).hexdigest(), d
        assert (got[d].near_edited == 1.0) == (got[d].fingerprint == got[d].edited_fingerprint)
        assert got[d].near_next in (0.0, 1.0)
    assert got[rows[0][0]].near_next == 1.0 if texts[0].split() == texts[1].split() else True


def test_bytes_are_compared_inside_a_bucket(spark, monkeypatch):
    monkeypatch.setattr(exact, "wide_hash", lambda c: exact.F.lit("00" * 16))
    docs = spark.createDataFrame([(1, "a", 0), (2, "b", 0), (3, "A", 0)], KIND)
    got = by_id(exact.fingerprints(docs).collect())
    assert got[1].fingerprint == got[3].fingerprint != got[2].fingerprint
    assert got[1].near_next == 0.0
    assert {got[i].edited_fingerprint for i in (1, 2)} == {got[i].fingerprint for i in (1, 2)}


def test_small_tables_and_null_ids(spark, tmp_path):
    assert exact.fingerprints(spark.createDataFrame([], KIND)).collect() == []
    one = exact.fingerprints(spark.createDataFrame([(4, "abcdefgh", 0)], KIND)).collect()
    assert one[0].edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest() and one[0].near_next == 1.0
    docs = spark.createDataFrame([(None, "first one", 0), (2, "second x", 0), (2, "second x", 0)], KIND)
    got = exact.fingerprints(docs).collect()
    assert len(got) == 3
    assert {r.edited_sha256 for r in got if r.doc_id is None} == {hashlib.sha256(b"first ose").hexdigest()}
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert op4_fingerprints(spark, str(tmp_path)).count() == 3


def test_many_rows_of_one_id(spark, monkeypatch):
    """Null and repeated ids, far more than a part holds, and cells that are cut evenly."""
    monkeypatch.setattr(exact, "ROWS", 20)
    monkeypatch.setattr(exact, "CELLS", 3)
    rows = [(None, f"null text {i}" + "y" * (i % 9), 0) for i in range(300)] + [(7, f"seven {i} é" * (i % 4 + 1), 0) for i in range(300)]
    rows += [(i * i, f"own {i}", 0) for i in range(8, 900)] + [(-5, None, 0), (9, "more", 0), (9, "more", 0)]
    docs = spark.createDataFrame(rows, KIND).repartition(3)
    marks = [tuple(r) for r in docs.select("doc_id", "text", exact.F.xxhash64("text").alias("m")).collect()]
    line = sorted(marks, key=lambda r: (r[0] is not None, r[0] or 0, r[2]))
    want = []
    for i, (d, t, _) in enumerate(line):
        t, n = t or "", line[(i + 1) % len(line)][1] or ""
        k = len(t) // 4
        want.append((str(d), len(t), hashlib.sha256((t[: len(t) - k] + n[:k]).encode()).hexdigest()))
    got = exact.fingerprints(docs).collect()
    assert sorted((str(r.doc_id), r.n_chars, r.edited_sha256) for r in got) == sorted(want)
    sizes = exact._slots(docs.select("doc_id", "text")).groupBy("part", "turn", "sub").count().collect()
    assert max(r["count"] for r in sizes) < 150
