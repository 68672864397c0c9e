"""Benchmark decontamination by spaced seeds.

A seed is the hash of some of ``SPAN`` words in a row: a fixed mask says which
count, so words at the other places may be substituted.  Seeds of all places of
all texts meet those of the benchmark; each hit says how a text and an item
are aligned, and the aligned words are compared.  A text is contaminated by an
item if some ``LEAST`` aligned words in a row (all of a shorter item) agree in
at least ``SHARE`` of them.  Where fewer than ``SPAN`` words are compared, they
are looked for as windows of the same length.  SQL functions only.
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, columns_apart, cut

#: Places of a seed's words that count.
MASKS = ("11010011", "10011101", "11111000", "01101011")
SPAN = 8
#: Aligned words compared and the share of them that must agree.
LEAST, SHARE = 15, 0.8
#: Rows up to which the benchmark's seeds, or the texts that were hit, are broadcast.
SEEDS, HITS = 500_000, 100_000


def words(text: Column) -> Column:
    """Runs of letters and digits in lower case; null as none."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", -1), lambda w: w != "")


def seeds(rows: DataFrame, *keep: str) -> DataFrame:
    """The kept columns, place and key of every seed of ``words``; two words differ where their XXH64 do."""
    hashes = F.transform("words", lambda w: F.xxhash64(w))
    many = F.greatest(F.size("words") - (SPAN - 1), F.lit(0))
    shifted = rows.select(*keep, hashes.alias("h"), many.alias("n")).where("n > 0")
    zipped = F.arrays_zip(*[F.slice("h", i + 1, F.col("n")).alias(f"w{i}") for i in range(SPAN)])
    each = shifted.select(*keep, F.posexplode(zipped).alias("place", "w")).select(*keep, "place", *[F.col("w")[f"w{i}"].alias(f"w{i}") for i in range(SPAN)])
    keys = [F.xxhash64(F.lit(m), *[F.col(f"w{i}") for i, c in enumerate(mask) if c == "1"]) for m, mask in enumerate(MASKS)]
    return each.select(*keep, "place", F.explode(F.array(*keys)).alias("key"))


def short_overlaps(own: DataFrame, items: DataFrame, least: int = LEAST, share: float = SHARE) -> DataFrame | None:
    """doc_id, mark, item_id, one (agree, back, compared) of overlaps of under SPAN words; none if no item is that short.

    A window of the text meets one of the item under the words that are left
    when as many as may differ are masked, for each choice of these.
    """
    items = items.select("item_id", "words", F.least(F.lit(least), F.size("words")).alias("compared")).where(F.col("compared").between(1, SPAN - 1))
    found = None
    for n in sorted(r.compared for r in items.select("compared").distinct().collect()):
        must = math.ceil(share * n - 1e-9)
        masks = list(combinations(range(n), max(must, 1)))

        def windows(rows: DataFrame, *keep: str) -> DataFrame:
            many = F.greatest(F.size("words") - (n - 1), F.lit(0))
            rows = rows.select(*keep, "words", many.alias("n")).where("n > 0")
            each = rows.select(*keep, F.posexplode(F.arrays_zip(*[F.slice("words", i + 1, F.col("n")).alias(f"w{i}") for i in range(n)])).alias("place", "w"))
            keys = [F.xxhash64(F.lit(m), *[F.col("w")[f"w{i}"] for i in mask]) for m, mask in enumerate(masks)]
            return each.select(*keep, "place", F.array(*[F.col("w")[f"w{i}"] for i in range(n)]).alias("w"), F.explode(F.array(*keys)).alias("key"))

        known = cut(windows(items.where(F.col("compared") == n), "item_id").select("item_id", F.col("w").alias("item"), "key").distinct(), "short")
        hits = windows(own, "doc_id", "mark").join(F.broadcast(known) if bounded(known, SEEDS) else known, "key")
        agree = F.aggregate(F.zip_with("w", "item", lambda a, b: (a == b).cast("int")), F.lit(0), lambda a, x: a + x)
        hits = hits.select("doc_id", "mark", "item_id", F.struct(agree.alias("agree"), (-F.col("place")).alias("back"), F.lit(n).alias("compared")).alias("one"))
        hits = hits.where(F.col("one.agree") >= must)
        found = hits if found is None else found.unionByName(hits)
    return found


def overlaps(docs: DataFrame, benchmark: DataFrame, least: int = LEAST, share: float = SHARE) -> DataFrame:
    """doc_id, mark, item_id, place, compared, agree: each text and item with an overlap.

    ``place`` is where the best run of words begins in the text, ``mark`` a
    hash of the text that tells rows with one doc_id apart.  Null and empty
    texts have no words.  Items with a null item_id are not looked for.  Repeated rows of
    ``docs`` are found once; repeated items with one item_id count as one each.
    Very long texts and items are compared whole.  An empty table on either
    side gives no rows.  Other columns are ignored, whatever their names.
    """
    items = columns_apart(benchmark, "item_id", "text").where("item_id is not null").select("item_id", words(F.col("text")).alias("words")).distinct()
    items = cut(items.withColumn("item_mark", F.xxhash64("words")), "items")
    known = cut(seeds(items, "item_id", "item_mark").distinct(), "seeds")
    small = bounded(known, SEEDS)
    hint = F.broadcast if small else (lambda df: df)
    text = F.coalesce("text", F.lit(""))
    own = columns_apart(docs, "doc_id", "text").select("doc_id", F.xxhash64(text).alias("mark"), words(text).alias("words"))
    hits = seeds(own, "doc_id", "mark").join(hint(known.withColumnRenamed("place", "at")), "key")
    hits = hits.select("doc_id", "mark", "item_id", "item_mark", (F.col("place") - F.col("at")).alias("shift")).distinct()
    hits = cut(hits, "hits")
    few = F.broadcast(items) if bounded(items, HITS) else items
    aligned = hits.join(few, ["item_id", "item_mark"]).withColumnRenamed("words", "item")
    same = F.col("o.doc_id").eqNullSafe(F.col("a.doc_id")) & (F.col("o.mark") == F.col("a.mark"))
    told = hits.select("doc_id", "mark").distinct()
    told = (F.broadcast(told) if bounded(told, HITS) else told).alias("a")
    held = own.alias("o").join(told, same, "left_semi").dropDuplicates(["doc_id", "mark"])
    both = aligned.alias("a").join(held.alias("o"), same).select("o.doc_id", "o.mark", "a.item_id", "a.item", "a.shift", "o.words")
    # Of the places of the item that lie inside the text, which agree.
    first = F.greatest(F.lit(0), -F.col("shift"))
    last = F.least(F.size("item"), F.size("words") - F.col("shift")) - 1
    both = both.withColumn("first", first).withColumn("last", last).where("last >= first")
    agree = F.transform(F.sequence("first", "last"), lambda i: (F.get("item", i) == F.get("words", i + F.col("shift"))).cast("int"))
    both = both.select("doc_id", "mark", "item_id", "first", "shift", F.least(F.lit(least), F.size("item")).alias("compared"), agree.alias("agree"))
    both = both.where("size(agree) >= compared")
    # The best run of ``compared`` words, the first of equals.
    sums = F.transform(
        F.sequence(F.lit(0), F.size("agree") - F.col("compared")),
        lambda i: F.struct(F.aggregate(F.slice("agree", i + 1, F.col("compared")), F.lit(0), lambda a, x: a + x).alias("n"), (-i).alias("back")),
    )
    both = both.withColumn("best", F.array_max(sums))
    both = both.where(F.col("best.n") >= F.ceil(share * F.col("compared") - 1e-9))
    one = F.struct(F.col("best.n").alias("agree"), (-(F.col("first") + F.col("shift") - F.col("best.back"))).alias("back"), "compared")
    both = both.select("doc_id", "mark", "item_id", one.alias("one"))
    brief = short_overlaps(own, items, least, share)
    if brief is not None:
        both = both.unionByName(brief)
    top = both.groupBy("doc_id", "mark", "item_id").agg(F.max("one").alias("one"))
    return top.select("doc_id", "mark", "item_id", (-F.col("one.back")).cast("long").alias("place"), F.col("one.compared").cast("long").alias("compared"), F.col("one.agree").cast("long").alias("agree"))


def clean(docs: DataFrame, benchmark: DataFrame, least: int = LEAST, share: float = SHARE) -> DataFrame:
    """``docs`` without the rows whose text is contaminated by any item.

    Null and empty texts stay, repeated rows go or stay together, very long
    texts are read whole.  All columns stay, whatever their names.  No rows
    give none; without items all stay.
    """
    bad = cut(overlaps(docs, benchmark, least, share).select("doc_id", "mark").distinct(), "contaminated")
    mark = F.xxhash64(F.coalesce(F.col("d.text"), F.lit("")))
    if bounded(bad, HITS):
        bad = F.broadcast(bad)
    return docs.alias("d").join(bad.alias("b"), F.col("d.doc_id").eqNullSafe(F.col("b.doc_id")) & (mark == F.col("b.mark")), "left_anti")
