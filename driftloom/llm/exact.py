"""Canonical exact digests of documents.

A text is canonical after NFKC composition, default case folding and folding
of white space.  Its fingerprint is two XXH64 of that with different seeds,
128 bits in all.  Texts and edited texts are grouped by it.  A group whose
members differ in a second digest, of SHA-256, is compared byte for byte, and
where its bytes differ the fingerprint gets that digest behind it.  Likeness is
whether two fingerprints name the same group.  SQL functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, columns_apart, cut

#: Text that sets the second hash apart.
OTHER = "other half"
#: Rows of a part that is put in order at once, cells of doc_id with bounds of their own, rows up to which a table is broadcast.
ROWS, CELLS, SMALL = 2000, 1024, 100_000
#: Of so many rows one may have a doc_id before rows of that doc_id are dealt by their texts.
HOT = 1000


def canonical(text: Column) -> Column:
    """NFKC, case folding, white space folded to single spaces and trimmed; null as empty."""
    text = F.coalesce(text, F.lit(""))
    wide = F.call_function("reflect", F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), text, F.lit(True))
    folded = F.call_function("reflect", F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), wide, F.lit(True))
    again = F.call_function("reflect", F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), folded, F.lit(True))
    ascii_only = F.length(text) == F.octet_length(text)
    plain = F.when(ascii_only, F.lower(text)).otherwise(again)
    return F.trim(F.regexp_replace(plain, r"[\s\x1c-\x1f\x85\p{Z}]+", " "))


def wide_hash(canon: Column) -> Column:
    """32 hexadecimal digits."""
    half = lambda *c: F.lpad(F.lower(F.hex(F.xxhash64(*c))), 16, "0")
    return F.concat(half(canon), half(F.lit(OTHER), canon))


def groups(prints: DataFrame) -> DataFrame:
    """hash, rows, one: whether all members of a group agree in their second digest; of (hash, sha)."""
    part = lambda at: F.conv(F.substring("sha", at, 15), 16, 10).cast("long")
    own = prints.select("hash", part(1).alias("x"), part(16).alias("y"))
    return own.groupBy("hash").agg(F.count(F.lit(1)).alias("rows"), ((F.min("x") == F.max("x")) & (F.min("y") == F.max("y"))).alias("one"))


def collided(canon: DataFrame, doubtful: DataFrame) -> DataFrame:
    """hash of the doubtful groups whose canonical texts (hash, canon) differ byte for byte."""
    held = canon.join(doubtful, "hash", "left_semi")
    return held.groupBy("hash").agg((F.min("canon") != F.max("canon")).alias("differ")).where("differ").select("hash")


def _slots(own: DataFrame) -> DataFrame:
    """``own`` (doc_id, text) with mark, a hash of the text, and part, turn, sub: ordered as doc_id (null first), then mark.

    Parts are cells between quantiles of doc_id, cut evenly into as many as
    the rows need.  Rows of a doc_id that very many have are dealt by mark.
    """
    own = own.withColumn("mark", F.xxhash64("text"))
    rows = max(1, own.count())
    cells = max(1, min(CELLS, rows // ROWS))
    finer = max(1, rows // (CELLS * ROWS))
    marks = own.stat.approxQuantile("doc_id", [i / cells for i in range(cells + 1)], 0.25 / cells) if cells > 1 else []
    marks = sorted({int(c) for c in marks})
    cuts = marks[1:-1]
    doc_id = F.col("doc_id")

    def cell(i: int) -> Column:
        if finer == 1 or not cuts:
            return F.lit(i * finer).cast("long")
        low, high = marks[i], marks[i + 1]
        return (F.lit(i * finer) + F.greatest(F.lit(0), F.least(F.lit(finer - 1), F.floor((doc_id - low) * F.lit(finer) / F.lit(high - low))))).cast("long")

    def tree(low: int, high: int) -> Column:
        if low == high:
            return cell(low)
        mid = (low + high) // 2
        return F.when(doc_id < cuts[mid], tree(low, mid)).otherwise(tree(mid + 1, high))

    part = F.when(doc_id.isNull(), F.lit(-1).cast("long")).otherwise(tree(0, len(cuts)))
    counts = own.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where((F.col("n") > ROWS) & (F.col("n") * HOT > rows))
    hot = {r["doc_id"]: r["n"] for r in counts.collect()}  # no more than HOT of them
    turn, sub = F.lit(0), F.lit(0).cast("long")
    if hot:
        known = sorted(h for h in hot if h is not None)
        below = F.size(F.filter(F.array(*map(F.lit, known)), lambda h: h < doc_id)) if known else F.lit(0)
        is_hot = F.coalesce(doc_id.isin(known), F.lit(None in hot)) if known else doc_id.isNull()
        turn = F.when(is_hot, F.lit(1)).otherwise(F.lit(0)) + F.when(doc_id.isNull(), F.lit(0)).otherwise(2 * below)
        bits = max(1, (max(hot.values()) // ROWS).bit_length())
        sub = F.when(is_hot, F.shiftright("mark", 64 - min(bits, 32))).otherwise(F.lit(0).cast("long"))
    return own.withColumn("part", part).withColumn("turn", turn).withColumn("sub", sub)


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, next_text, where the next row is by doc_id (null first), then a hash of the text.

    The last row's next is the first.  No task orders all rows: each slot's
    first text is joined to the slot before it.
    """
    slot = ["part", "turn", "sub"]
    own = _slots(columns_apart(docs, "doc_id", "text"))
    place = F.struct(F.col("doc_id").isNotNull().alias("some"), "doc_id", "mark")
    firsts = cut(own.groupBy(*slot).agg(F.min(place).alias("place")), "firsts")
    found = own.withColumn("place", place).join(F.broadcast(firsts) if bounded(firsts, SMALL) else firsts, [*slot, "place"], "left_semi")
    heads = found.groupBy(*slot).agg(F.min(F.struct(F.col("text").isNotNull().alias("some"), "text")).alias("h"))
    heads = cut(heads.select(*slot, F.col("h.text").alias("head")), "heads")
    line = Window.orderBy(*slot)
    ends = heads.select(*slot).withColumn("before", F.lag(F.struct(*slot)).over(line))
    whole = line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = ends.withColumn("before", F.coalesce("before", F.max(F.struct(*slot)).over(whole)))
    heads = heads.join(ends, slot).select("before.*", "head", F.lit(True).alias("at_end"))
    order = Window.partitionBy(*slot).orderBy(F.col("doc_id").asc_nulls_first(), "mark", "text")
    own = own.withColumn("follows", F.lead(F.struct("text")).over(order))
    inner = own.where("follows is not null").select("doc_id", "text", F.col("follows.text").alias("next_text"))
    outer = own.where("follows is null").withColumn("at_end", F.lit(True)).join(heads, [*slot, "at_end"]).select("doc_id", "text", F.col("head").alias("next_text"))
    return inner.unionByName(outer)


def edited(text: Column, follows: Column) -> Column:
    """The last quarter of the code points replaced by as many first ones of the next text."""
    k = F.floor(F.length(text) / 4).cast("int")
    return F.concat(F.substr(text, F.lit(1), F.length(text) - k), F.substr(follows, F.lit(1), k))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of each row (doc_id, text).

    doc_id is a whole number.  Null texts are empty; very long ones are read
    whole.  Rows with a null doc_id come before all others; rows with one
    doc_id follow each other by a hash of their texts, repeated rows in any
    order.  Likeness is 1 where two fingerprints are one, else 0.  A single
    row follows itself; no rows give none.  Other columns are not looked at,
    whatever their names.
    """
    def texts() -> DataFrame:
        own = with_next(docs).select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("next_text", F.lit("")).alias("next_text"))
        return own.withColumn("edited", edited(F.col("text"), F.col("next_text")))

    canon = [canonical(F.col(c)).alias(a) for c, a in (("text", "a"), ("edited", "b"), ("next_text", "c"))]
    own = texts().select("doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), *canon)
    own = own.select("doc_id", "n_chars", "edited_sha256", *[wide_hash(F.col(c)).alias(c) for c in "abc"], *[F.sha2(c, 256).alias(f"sha_{c}") for c in "abc"])
    own = cut(own, "prints")
    members = own.select(F.inline(F.array(*[F.struct(F.col(c).alias("hash"), F.col(f"sha_{c}").alias("sha")) for c in "ab"])))
    doubtful = groups(members).where("not one").select("hash")
    names = {c: F.col(c) for c in "abc"}
    if doubtful.limit(1).count():  # such groups are, for 128 bits, as good as never met
        doubtful = cut(doubtful, "doubtful")
        both = texts().select(F.explode(F.array(*[F.struct(canonical(F.col(c)).alias("canon")) for c in ("text", "edited")])).alias("t")).select("t.canon")
        clash = cut(collided(both.select("canon", wide_hash(F.col("canon")).alias("hash")), doubtful), "clashes")
        for c in "abc":
            own = own.join(clash.select(F.col("hash").alias(c), F.lit(True).alias(f"clash_{c}")), c, "left")
            names[c] = F.concat(F.col(c), F.when(F.col(f"clash_{c}"), F.concat(F.lit("-"), F.col(f"sha_{c}"))).otherwise(F.lit("")))
    alike = lambda c: (names["a"] == names[c]).cast("double")
    return own.select(
        "doc_id", "n_chars", "edited_sha256", names["a"].alias("fingerprint"), names["b"].alias("edited_fingerprint"),
        alike("b").alias("near_edited"), alike("c").alias("near_next"),
    )
