import base64
import hashlib

from driftloom.llm import warc
from driftloom.llm.queries import op3_warc

KIND = "page_id long, url string, html string, payload int, digest string"


def archive(spark, tmp_path, rows, **more):
    path = f"{tmp_path}/a"
    warc.write(spark.createDataFrame(rows, KIND), path, **more)
    return path


def test_round_trip(spark, tmp_path):
    rows = [(i, f"http://x/{i % 3}", "<p>é%d" % (i % 4), 0, "q") for i in range(300)]
    rows += [(900, None, None, 0, "q"), (901, "http://a b\r\nX: y", "", 0, "q"), (None, "u", "<p>é0", 0, "q"), (902, "", "z" * 300_000, 0, None), (903, " é\u2028\x85z", "k", 0, None)]
    path = archive(spark, tmp_path, rows)
    got = warc.read(spark, path).collect()
    assert len(got) == len(rows) and all(r.whole for r in got)
    last = {}
    for i, _, h, *_ in rows:
        last[h or ""] = max(last.get(h or "", -1), -1 if i is None else i)
    by = {r.page_id: r for r in got}
    for i, u, h, *_ in rows:
        raw, r = (h or "").encode(), by[i]
        assert r.payload_bytes == len(raw) and r.payload_digest == base64.b32encode(hashlib.sha1(raw).digest()).decode()
        assert r.url == u
        first = last[h or ""] == i
        assert (r.record_type, r.refers_to) == (("response", None) if first else ("revisit", last[h or ""]))
    assert spark.read.parquet(f"{path}/payloads").count() == len(last)
    raw = [bytes(r.record) for r in warc.records(spark, path).collect()]
    assert all(r.startswith(b"WARC/1.1\r\nWARC-Type: ") and r.endswith(b"\r\n\r\n") for r in raw)
    assert any(b"Content-Length: 300000\r\n\r\n" + b"z" * 300_000 + b"\r\n\r\n" in r for r in raw)


def test_least_bytes_repeats_and_nothing(spark, tmp_path):
    rows = [(1, "u", "ab", 0, ""), (2, "u", "ab", 0, ""), (3, "u", "abcdef", 0, ""), (4, "u", "abcdef", 0, ""), (4, "u", "abcdef", 0, "")]
    got = sorted((r.page_id, r.record_type) for r in warc.read(spark, archive(spark, tmp_path, rows, least_bytes=3)).collect())
    assert got == [(1, "response"), (2, "response"), (3, "revisit"), (4, "response"), (4, "response")]
    spark.createDataFrame([], KIND).write.parquet(f"{tmp_path}/pages.parquet")
    assert op3_warc(spark, str(tmp_path)).collect() == []


def test_what_is_changed_in_the_archive_is_told(spark, tmp_path):
    """The rows come from the rebuilt records: a body or a header that was changed shows in them."""
    from pyspark.sql import functions as F

    rows = [(1, "u", "<p>\r\n\r\nlines", 0, ""), (2, "u", "same", 0, ""), (3, "u", "same", 0, ""), (4, "é", "last", 0, "")]
    path = archive(spark, tmp_path, rows)
    assert all(r.whole for r in warc.read(spark, path).collect())
    spark.read.parquet(f"{path}/payloads").withColumn("payload", F.when(F.col("payload") == F.lit(b"same"), F.lit(b"sane")).otherwise(F.col("payload"))).write.parquet(f"{tmp_path}/b/payloads")
    spark.read.parquet(f"{path}/heads").withColumn("head", F.encode(F.replace(F.decode("head", "UTF-8"), F.lit("Content-Length: 12"), F.lit("Content-Length: 11")), "UTF-8")).write.parquet(f"{tmp_path}/b/heads")
    got = {r.page_id: r for r in warc.read(spark, f"{tmp_path}/b").collect()}
    assert {i: r.whole for i, r in got.items()} == {1: False, 2: False, 3: False, 4: True}
    assert got[3].payload_digest == got[2].payload_digest == base64.b32encode(hashlib.sha1(b"sane").digest()).decode()
