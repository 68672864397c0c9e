"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

The documents of a source are dealt by a hash into blocks, whose order is a
seeded permutation.  A source's target fixes its quota: how many blocks are
drawn, in whole passes over all of them and one pass over some.  A binary tree
splits the quotas over the output shards: at each node a multivariate
hypergeometric draw says how many blocks of each source go to the left half,
which takes half of all.  The leaves decide what is drawn: a shard owns a
stretch of each source's permutation that is as long as its quota and its
share of the blocks that no one draws, and draws the first ones of it, so
shards draw disjoint blocks.  Inside a shard documents are ordered by a hash.

Blocks differ in words.  So the last draws of a source are cut, or the next
blocks of the permutation are added, until its words are the target to the
word; one block is drawn in part.  All of it is DataFrame functions; the plan
has a row for each block, and what is known of a source fits in one row.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, columns_apart, cut

#: Words of a block in a large source, blocks of a smaller one, shards of the output, most times that a document is taken.
BLOCK_WORDS, LEAST_BLOCKS, SHARDS, MOST = 8 << 20, 512, 8, 3
#: Rows of a plan up to which it is broadcast.
SMALL = 200_000
WORD = r"[^\x20\x09-\x0D]+"
#: Standard deviations beyond which a draw is taken to be impossible (a chance of 1e-32).
REACH = 12.0
DRAW = "array<struct<shard:bigint,place:bigint,words:bigint>>"


def _hash(seed: int, *parts) -> Column:
    return F.xxhash64(F.lit(seed), *parts)


def _uniform(*parts) -> Column:
    """A number in [0, 1) that depends on the parts alone."""
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 52)) / F.lit(float(1 << 52))


def _let(value: Column, then) -> Column:
    """``then`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), then), 0)


def _hint(df: DataFrame) -> DataFrame:
    """For a broadcast, if its rows are counted to be few."""
    return F.broadcast(df) if bounded(df, SMALL) else df


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = MOST) -> DataFrame:
    """source, source_size, weight, target of each source.

    The sources, by code point with null last, weigh ``weights`` in turn and
    share the words of all.  None gets over ``most`` times its size: the share
    of each is min(cap, level x weight), where the level spends all words.  In
    the order of cap / weight the capped sources come first, so the level is
    found by running sums over the sources.
    """
    own = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = Window.orderBy(F.col("source").asc_nulls_last())
    own = own.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(rank) - 1, F.lit(len(weights))) + 1).cast("int")).cast("double"))
    order = [F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()]
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    after = Window.orderBy(*order).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    own = own.withColumn("cap", F.col("source_size") * F.lit(float(most)))
    own = own.withColumn("all", F.sum("source_size").over(whole))
    own = own.withColumn("level", (F.col("all") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    own = own.withColumn("level", F.max(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))).over(whole))
    return own.select("source", "source_size", "weight", F.least("cap", F.coalesce(F.col("level"), F.lit(0.0)) * F.col("weight")).alias("target"))


def _log_factorial(n: Column) -> Column:
    """By a table below 16, from there by Stirling's series, whose error is under 1e-12."""
    n = n.cast("double")
    table = F.array(*[F.lit(math.lgamma(i + 1)) for i in range(16)])
    series = (n + 0.5) * F.ln(n) - n + F.lit(0.5 * math.log(2 * math.pi)) + 1 / (12 * n) - 1 / (360 * n * n * n) + 1 / (1260 * n * n * n * n * n)
    return F.when(n < 16, F.get(table, n.cast("int"))).otherwise(series)


def hypergeometric(u: Column, total: Column, marked: Column, drawn: Column) -> Column:
    """How many of ``drawn`` of ``total`` blocks are among the ``marked`` ones, by inversion of ``u`` in [0, 1).

    The probabilities follow from one to the next, from ``REACH`` deviations
    below the mean on, so a draw takes as many steps as its deviation is wide.
    """
    mean = F.when(total > 0, drawn * marked / total).otherwise(0.0)
    spread = F.sqrt(F.greatest(F.lit(0.0), F.when(total > 1, mean * (1 - marked / total) * (total - drawn) / (total - 1)).otherwise(0.0)))
    low = F.greatest(F.lit(0).cast("long"), drawn - (total - marked), F.floor(mean - REACH * spread - 2).cast("long"))
    high = F.least(drawn, marked, F.ceil(mean + REACH * spread + 2).cast("long"))
    choose = lambda n, k: _log_factorial(n) - _log_factorial(k) - _log_factorial(n - k)

    def walk(r):
        first = F.exp(choose(marked, r["low"]) + choose(total - marked, drawn - r["low"]) - choose(total, drawn))
        start = F.struct(r["low"].alias("k"), first.alias("p"), first.alias("upto"))

        def step(s, i):
            k = s["k"].cast("double")
            p = s["p"] * (marked - k) * (drawn - k) / ((k + 1) * (total - marked - drawn + k + 1))
            return F.when((u < s["upto"]) | (s["k"] >= r["high"]), s).otherwise(F.struct((s["k"] + 1).alias("k"), p.alias("p"), (s["upto"] + p).alias("upto")))

        return F.aggregate(F.sequence(F.lit(1).cast("long"), F.greatest(r["high"] - r["low"], F.lit(1))), start, step, lambda s: s["k"])

    return _let(F.struct(low.alias("low"), high.alias("high")), walk)


def _left_draws(seed: int, parts: Column, node: Column) -> Column:
    """How many of each source's blocks go to the left half of a node.

    ``parts`` is an array of (source, quota).  Half of all blocks (rounded up)
    go left.  Source after source, the number is hypergeometric among the
    blocks of this source and those after it, so all together are multivariate
    hypergeometric.
    """
    total = F.aggregate(parts, F.lit(0).cast("long"), lambda a, p: a + p["quota"])
    start = F.struct(F.floor((total + 1) / 2).cast("long").alias("open"), total.alias("left"), F.array().cast("array<bigint>").alias("out"))

    def step(a, p):
        n = hypergeometric(_uniform(F.lit(seed), node, p["source"]), a["left"], p["quota"], a["open"])
        return _let(n, lambda n: F.struct((a["open"] - n).alias("open"), (a["left"] - p["quota"]).alias("left"), F.concat(a["out"], F.array(n)).alias("out")))

    return F.aggregate(parts, start, step, lambda a: a["out"])


def split(quotas: DataFrame, shards: int = SHARDS, seed: int = 9) -> DataFrame:
    """source, shard, quota: exact quotas (source, quota) split over the shards.

    ``shards`` is a power of two.  One row holds a node's quotas of all sources.
    """
    if shards < 1 or shards & (shards - 1):
        raise ValueError("shards must be a power of two")
    part = F.struct("source", "quota")
    nodes = quotas.agg(F.sort_array(F.collect_list(part)).alias("parts")).select(F.lit(1).cast("long").alias("node"), "parts")
    width = 1
    while width < shards:
        drawn = nodes.withColumn("draws", _left_draws(seed, F.col("parts"), F.col("node")))
        left = F.transform("parts", lambda p, i: F.struct(p["source"].alias("source"), F.get("draws", i).alias("quota")))
        right = F.transform("parts", lambda p, i: F.struct(p["source"].alias("source"), (p["quota"] - F.get("draws", i)).alias("quota")))
        sides = F.array(F.struct((F.col("node") * 2).alias("node"), left.alias("parts")), F.struct((F.col("node") * 2 + 1).alias("node"), right.alias("parts")))
        nodes = drawn.select(F.inline(sides))
        width *= 2
    return nodes.select((F.col("node") - shards).alias("shard"), F.inline("parts")).select("source", "shard", "quota")


def _blocks(words: Column) -> Column:
    """Into how many blocks a source of so many words is dealt."""
    return F.greatest(F.lit(LEAST_BLOCKS), F.ceil(words / BLOCK_WORDS)).cast("long")


def plan(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), shards: int = SHARDS, seed: int = 9) -> DataFrame:
    """of (source), block, source_size, target, passes, words, extra, copies: what is drawn of each block.

    ``sizes`` is (source, mark, size), ``mark`` a hash that deals rows to
    blocks.  A block is taken ``passes`` times whole, and ``extra`` words of it
    once more; copies has (copy, shard) of each.
    """
    goal = targets(sizes, weights)
    goal = goal.withColumn("goal", F.round("target").cast("long")).withColumn("blocks", _blocks(F.col("source_size")))
    goal = goal.withColumn("passes", F.floor(F.col("goal") / F.greatest("source_size", F.lit(1))).cast("long"))
    goal = cut(goal.withColumn("rest", F.col("goal") - F.col("passes") * F.col("source_size")).withColumnRenamed("source", "of"), "targets", 1)
    same = F.col("source").eqNullSafe(F.col("of"))
    dealt = sizes.join(_hint(goal.select("of", "blocks")), same).withColumn("block", F.pmod("mark", "blocks"))
    blocks = cut(dealt.groupBy("of", "block").agg(F.sum("size").alias("words")), "blocks")
    # A source's quota: its blocks with words, once a pass, and as many more as the rest is worth.
    known = blocks.groupBy("of").agg(F.count_if(F.col("words") > 0).alias("n"))
    known = known.join(goal.withColumnRenamed("of", "o"), F.col("of").eqNullSafe(F.col("o"))).drop("o", "blocks")
    some = F.when(F.col("source_size") > 0, F.ceil(F.col("rest") * F.col("n") / F.col("source_size"))).otherwise(0).cast("long")
    known = known.withColumn("some", some).withColumn("quota", F.col("passes") * F.col("n") + F.col("some"))
    known = cut(known, "quotas", 1)
    leaves = split(known.select(F.col("of").alias("source"), "quota"), shards, seed)
    # Draw number d of a source is of the shard whose run of draws it is in; the shard's stretch begins behind those of the shards before it.
    upto = Window.partitionBy("source").orderBy("shard")
    runs = leaves.withColumn("upto", F.sum("quota").over(upto)).groupBy("source").agg(F.array_sort(F.collect_list(F.struct("upto", "shard"))).alias("runs"))
    known = cut(known.join(runs, F.col("of").eqNullSafe(F.col("source"))).drop("source").withColumnRenamed("of", "o"), "runs", 1)
    order = Window.partitionBy("of").orderBy(F.col("words") == 0, _hash(seed + 1, "of", "block"), "block")
    rows = blocks.withColumn("rank", (F.row_number().over(order) - 1).cast("long"))
    rows = rows.join(_hint(known), F.col("of").eqNullSafe(F.col("o"))).drop("o")
    shard_of = lambda d: F.array_min(F.filter("runs", lambda r: r["upto"] > d))["shard"]
    # In the pass over some blocks, a shard's draws stand behind the idle blocks of the shards before it.
    first = F.col("passes") * F.col("n")
    idle = lambda s: F.floor((F.col("n") - F.col("some")) * s / F.lit(shards)).cast("long")
    ends = F.transform(F.filter("runs", lambda r: r["upto"] > first), lambda r: F.struct((r["upto"] - first).alias("upto"), r["shard"].alias("shard")))
    stretches = F.transform(
        ends, lambda r, i: F.struct(
            r["shard"].alias("shard"), F.coalesce(F.get(ends, i - 1)["upto"], F.lit(0)).alias("drawn"),
            (F.coalesce(F.get(ends, i - 1)["upto"], F.lit(0)) + idle(r["shard"])).alias("begin"), (r["upto"] + idle(r["shard"])).alias("end"),
        ),
    )
    inside = F.get(F.filter("stretches", lambda r: (r["begin"] <= F.col("rank")) & (F.col("rank") < r["end"])), 0)
    rows = rows.withColumn("stretches", stretches).withColumn("mine", F.when(F.col("words") > 0, inside))
    number = F.when(F.col("mine").isNotNull(), F.col("mine.drawn") + F.col("rank") - F.col("mine.begin"))
    rows = rows.withColumn("number", number)
    # Words by draws, then by the blocks that no shard draws: a run as long as the rest.
    line = Window.partitionBy("of").orderBy(F.col("words") == 0, F.col("number").asc_nulls_last(), "rank")
    rows = rows.withColumn("upto", F.sum("words").over(line))
    rows = rows.withColumn("extra", F.greatest(F.lit(0), F.least("words", F.col("rest") - F.col("upto") + F.col("words"))).cast("long"))
    last = F.element_at(F.transform("runs", lambda r: r["shard"]), -1)
    whole = F.transform(F.slice(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("passes") - 1, F.lit(0))), F.lit(1), F.col("passes").cast("int")), lambda c: F.struct(c.alias("copy"), shard_of(c * F.col("n") + F.col("rank")).alias("shard")))
    once = F.when((F.col("extra") > 0), F.array(F.struct(F.col("passes").alias("copy"), F.coalesce(F.col("mine.shard"), last).alias("shard")))).otherwise(F.array().cast("array<struct<copy:bigint,shard:bigint>>"))
    copies = F.when(F.col("words") > 0, F.concat(whole, once)).otherwise(F.array().cast("array<struct<copy:bigint,shard:bigint>>"))
    return cut(rows.select("of", "block", "source_size", "target", "passes", "words", "extra", copies.alias("copies")), "plan")


def _taken(rows: DataFrame, found: DataFrame, seed: int, size: Column, names: tuple[str, ...]) -> DataFrame:
    """``rows`` (with _id, _source, _mark) with what the plan takes of each, in columns of the given names.

    Blocks drawn whole or not need no order.  Only of a block drawn in part,
    one a source, the rows are summed up one after another.
    """
    blocks = found.groupBy("of").agg(F.max(_blocks(F.col("source_size"))).alias("_blocks")).withColumnRenamed("of", "_of")
    rows = rows.join(_hint(cut(blocks, "dealt", 1)), F.col("_source").eqNullSafe(F.col("_of"))).withColumn("_at", F.pmod("_mark", "_blocks")).drop("_of", "_blocks")
    small = bounded(found, SMALL)
    told = found.select(*[F.col(c).alias(f"_{c}") for c in ("of", "block", "source_size", "target", "passes", "words", "extra", "copies")])

    def joined(some: DataFrame) -> DataFrame:
        some = F.broadcast(some) if small else some
        return rows.join(some, F.col("_source").eqNullSafe(F.col("_of")) & (F.col("_at") == F.col("_block"))).withColumn("_size", size)

    part = (F.col("_extra") > 0) & (F.col("_extra") < F.col("_words"))
    whole = joined(told.where(~part)).withColumn("_more", F.when(F.col("_extra") > 0, F.col("_size")).otherwise(0).cast("long"))
    within = Window.partitionBy("_source", "_block").orderBy(_hash(seed + 2, "_id", "_mark"), "_id", "_size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    some = joined(told.where(part)).withColumn("_upto", F.sum("_size").over(within))
    some = some.withColumn("_more", F.greatest(F.lit(0), F.least("_size", F.col("_extra") - F.col("_upto") + F.col("_size"))).cast("long")).drop("_upto")
    rows = whole.unionByName(some)
    words = lambda c: F.when(c["copy"] < F.col("_passes"), F.col("_size")).otherwise(F.col("_more"))
    place = lambda c: _hash(seed + 3, "_id", "_mark", c["copy"])
    draws = F.filter(F.transform("_copies", lambda c: F.struct(c["shard"].alias("shard"), place(c).alias("place"), words(c).alias("words"))), lambda d: d["words"] > 0)
    made = (F.col("_size"), F.col("_source_size"), F.col("_target"), F.col("_passes") * F.col("_size") + F.col("_more"), draws.cast(DRAW))
    kept = [c for c in rows.columns if not c.startswith("_")]
    return rows.select(*[F.col(f"`{c}`") for c in kept], *[m.alias(n) for m, n in zip(made, names)])


def _sizes(docs: DataFrame, seed: int) -> DataFrame:
    own = columns_apart(docs, "doc_id", "source", "text")
    # Rows without an id, or with the same, are told apart by their texts.
    return cut(own.select("doc_id", "source", _hash(seed, "doc_id", "text").alias("mark"), words_in(F.col("text")).alias("size")), "sizes")


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), shards: int = SHARDS, seed: int = 9) -> DataFrame:
    """One row for each row of (doc_id, source, text): its draws into the mix.

    Returns doc_id, source, size, source_size, target, taken, and draws: an
    array of (shard, place, words) for the copies taken, ``place`` ordering a
    shard.  Documents without words (null or blank text) are never drawn; a
    very long one is cut only where it is the last of the words that its
    source gets.  Null sources form one source, the last, and a hot source is
    spread over its blocks.  Repeated rows count each by itself; of rows that
    agree in doc_id and text any may be the one that is cut.  The same rows
    give the same mix, in whatever order they come.  No rows give none.  Other
    columns are not looked at, whatever their names.
    """
    own = _sizes(docs, seed)
    found = plan(own, weights, shards, seed)
    rows = own.select("doc_id", "source", F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("mark").alias("_mark"), F.col("size").alias("_n"))
    return _taken(rows, found, seed, F.col("_n"), ("size", "source_size", "target", "taken", "draws"))


def drawn(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), shards: int = SHARDS, seed: int = 9) -> DataFrame:
    """The rows of ``docs``, all columns, that the mix takes words of, with size, source_size, target, taken and draws.

    As ``mix``; a new column whose name ``docs`` has already gets ``_mix``
    behind it, as often as needed.
    """
    taken = {c.lower() for c in docs.columns}
    names = []
    for n in ("size", "source_size", "target", "taken", "draws"):
        while n in taken:
            n += "_mix"
        names.append(n)
    hidden = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    own = docs.toDF(*hidden.values())
    text, doc_id, source = (F.col(hidden[c]) for c in ("text", "doc_id", "source"))
    found = plan(_sizes(docs, seed), weights, shards, seed)
    rows = own.select("*", doc_id.alias("_id"), source.alias("_source"), _hash(seed, doc_id, text).alias("_mark"))
    out = _taken(rows, found, seed, words_in(text), tuple(f"m{i}" for i in range(5)))
    return out.where("m3 > 0").toDF(*docs.columns, *names)
