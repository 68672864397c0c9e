"""A content-addressed web archive.

Two tables make the archive: ``payloads`` holds each payload's bytes once under
its SHA-256, and ``heads`` holds the exact header bytes of every record with
that digest.  ``records`` joins them to the original records, and ``read``
parses what it gives; a revisit has no body, so only responses fetch payloads.
What is known of a payload besides its bytes has a fixed width and is joined to
revisits apart, so neither writing nor reading moves the bytes of a payload
once for each of its records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import columns_apart, cut, lookup, shared_dir

END = "\r\n"


def base32(digest_hex: Column) -> Column:
    """40 hexadecimal digits as 32 in base 32: each five make four."""
    parts = [F.lpad(F.conv(F.substring(digest_hex, i, 5), 16, 32), 4, "0") for i in range(1, 41, 5)]
    return F.translate(F.upper(F.concat(*parts)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _payload(html: Column) -> Column:
    return F.encode(F.coalesce(html, F.lit("")), "UTF-8")


def write(pages: DataFrame, path: str, least_bytes: int = 0) -> None:
    """Archive (page_id, url, html) under ``path``.

    Of the rows with equal payloads of ``least_bytes`` or more, that with the
    largest page_id is the response and others revisit it; smaller ones are
    all responses.  Null html is an empty payload; a null url has no target
    header; a null page_id is smaller than any.  Rows that repeat the largest
    page_id are responses too.  A url with blanks or control characters is
    archived with these as %-escapes, and besides as it is in base 64.  Very
    long payloads are kept whole.  No rows make an empty archive.  Other
    columns are not archived, whatever their names.
    """
    own = columns_apart(pages, "page_id", "url", "html").select("page_id", "url", _payload(F.col("html")).alias("payload"))
    own = own.withColumn("digest", F.sha2("payload", 256))
    kept = own.select("page_id", "url", "digest", F.octet_length("payload").cast("long").alias("bytes"), base32(F.sha1("payload")).alias("sha1"))
    # Equal digests are verified by a second one, of 512 bits, in all rows: one payload of each is enough.
    other = F.sha2("payload", 512)
    store = own.groupBy("digest").agg(F.first("payload").alias("payload"), F.min(other).alias("low"), F.max(other).alias("high"), F.count(F.lit(1)).alias("records"), F.max("page_id").alias("first"))
    store = store.withColumn("payload", F.when(F.col("low") == F.col("high"), F.col("payload")).otherwise(F.raise_error(F.lit("different payloads have one SHA-256"))))
    store.drop("low", "high").write.parquet(f"{path}/payloads")
    facts = _table(pages.sparkSession, f"{path}/payloads").select("digest", "records", "first")
    own = lookup(kept, facts, "digest", "records", kept.count())
    revisit = (F.col("bytes") >= least_bytes) & F.coalesce(~F.col("page_id").eqNullSafe(F.col("first")), F.lit(False))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(END))
    uri = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("none")), F.lit(">"))
    odd = r"[\x00-\x20\x7f-\x9f\u2028\u2029]"
    target = F.regexp_replace(F.col("url"), odd, "%20")
    head = F.concat(
        F.lit("WARC/1.1" + END),
        line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", uri(F.col("page_id"))),
        F.lit("WARC-Date: 1970-01-01T00:00:00Z" + END),
        F.coalesce(line("WARC-Target-URI", target), F.lit("")),
        F.when(F.col("url").rlike(odd) | (F.col("url") == ""), line("Target-URI-Base64", F.regexp_replace(F.base64(F.encode("url", "UTF-8")), r"\s", ""))).otherwise(F.lit("")),
        F.when(revisit, line("WARC-Refers-To", uri(F.col("first")))).otherwise(F.lit("")),
        F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" + END)).otherwise(F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        F.lit("Content-Type: text/html; charset=utf-8" + END),
        line("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.col("bytes").cast("string"))),
        F.lit(END),
    )
    heads = own.select(F.encode(head, "UTF-8").alias("head"), "digest")
    heads.write.parquet(f"{path}/heads")


def _table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def records(spark: SparkSession, path: str) -> DataFrame:
    """head, digest, record of each archived record: the WARC record as it was."""
    heads = _table(spark, f"{path}/heads")
    revisit = F.coalesce(_field(F.col("head"), "WARC-Type") == "revisit", F.lit(False))
    store = _table(spark, f"{path}/payloads").select("digest", "payload")
    end = F.lit(b"\r\n\r\n")
    whole = heads.where(~revisit).join(store, "digest").select("head", "digest", F.concat("head", "payload", end).alias("record"))
    return whole.unionByName(heads.where(revisit).select("head", "digest", F.concat("head", end).alias("record")))


def _field(head: Column, name: str) -> Column:
    """A header's value; null where it is absent."""
    value = F.regexp_extract(F.decode(head, "UTF-8"), rf"\r\n{name}: ([^\r\n]*)\r\n", 1)
    return F.when(value != "", value)


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row for each record, from the records as ``records`` rebuilds them.

    page_id, payload_bytes, payload_digest, record_type, refers_to, target_uri,
    url, and ``whole``: whether a record has its end, its header and its body
    agree in length and digest, and the body has the digest that it is stored
    under; of a revisit, whether header and the response's body agree.  An
    empty archive has no rows.
    """
    page = lambda c: F.try_to_number(F.regexp_extract(c, r"<urn:page:(-?\d+)>", 1), F.lit("S9999999999999999999")).cast("long")
    record = F.col("record")
    # The first empty line ends the header: no value in it has a line end.
    header = F.substring_index(F.decode(record, "UTF-8"), END * 2, 1)
    split = F.octet_length(F.encode(header, "UTF-8")) + len(END * 2)
    body = F.substr(record, split + 1, F.octet_length(record) - split - len(END * 2))
    ended = F.substr(record, F.octet_length(record) - 3, F.lit(4)) == F.lit(b"\r\n\r\n")
    head = F.substr(record, F.lit(1), split)
    parsed = records(spark, path).select("digest", head.alias("head"), ended.alias("ended"), F.octet_length(body).cast("long").alias("length"), base32(F.sha1(body)).alias("own"), F.sha2(body, 256).alias("sha256"))
    given, escaped = _field(F.col("head"), "WARC-Target-URI"), _field(F.col("head"), "Target-URI-Base64")
    empty = F.decode("head", "UTF-8").contains(END + "Target-URI-Base64: ")
    parsed = parsed.select(
        "digest",
        page(_field(F.col("head"), "WARC-Record-ID")).alias("page_id"),
        _field(F.col("head"), "WARC-Type").alias("record_type"),
        page(_field(F.col("head"), "WARC-Refers-To")).alias("refers_to"),
        given.alias("target_uri"),
        F.coalesce(F.decode(F.unbase64(escaped), "UTF-8"), F.when(empty, F.lit("")), given).alias("url"),
        F.regexp_extract(_field(F.col("head"), "WARC-Payload-Digest"), "^sha1:(.*)$", 1).alias("told"),
        (F.col("ended") & (F.col("length").cast("string") == _field(F.col("head"), "Content-Length"))).alias("sound"),
        "length", "own", (F.col("sha256") == F.col("digest")).alias("stored"),
    )
    parsed = cut(parsed, "parsed")
    revisit = F.coalesce(F.col("record_type") == "revisit", F.lit(False))
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "target_uri", "url", "whole"]
    responses = parsed.where(~revisit).withColumns({"payload_bytes": F.col("length"), "payload_digest": F.col("own"), "whole": F.col("sound") & F.col("stored") & (F.col("told") == F.col("own"))})
    # What is known of a payload, with the number of its revisits.
    again = parsed.where(revisit).drop("length", "own", "stored")
    facts = parsed.groupBy("digest").agg(F.max(F.when(~revisit, F.struct("length", "own", "stored"))).alias("f"), F.count_if(revisit).alias("many")).where("many > 0")
    revisits = lookup(again, cut(facts, "facts"), "digest", "many", again.count())
    revisits = revisits.withColumns({"payload_bytes": F.col("f.length"), "payload_digest": F.col("f.own"), "whole": F.coalesce(F.col("sound") & F.col("f.stored") & (F.col("told") == F.col("f.own")), F.lit(False))})
    return responses.select(columns).unionByName(revisits.select(columns))


def new_path(spark: SparkSession) -> str:
    """A fresh place in the shared folder."""
    import uuid

    return f"{shared_dir(spark)}/archive-{uuid.uuid4().hex}"
