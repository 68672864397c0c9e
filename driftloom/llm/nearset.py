"""Near-duplicates by the similarity of shingle sets.

Two texts are near-duplicates if the sets of their ``WORDS``-word shingles have
a Jaccard similarity of at least ``SHARE`` (four in five), and groups are what
such pairs connect.  SimHash fingerprints of the sets within ``DISTANCE`` bits
are met first, by op10's segment tables.  Similar sets may lie farther apart
(9.7 bits on average at the limit), and those are met by MinHash band keys: a
pair at the limit misses all keys with a probability of (1 - 0.8^4)^32 = 5e-8.
A few rounds link the members of a key to one of them, so a large group of
copies makes no pairs of its members.  What these leave apart may still be many
texts under one key that are a little less alike than the limit.  Pairs of
these are found exactly, by prefixes: with the rarest shingles first, similar
sets share one among the first of both, and the places of the first that they
share bound what they can have in common.  Every candidate is held against the
whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, columns_apart, cut, lookup
from .simhash import SEED, components, links, majority

#: Words of a shingle; bands and values of each.
WORDS, BANDS, VALUES = 5, 32, 4
#: Similarity as a ratio of whole numbers.
OVER, UNDER = 4, 5
#: Rounds that link members of a key to one of them; rows up to which a table is broadcast.
STARS, SMALL = 3, 100_000
#: Bits in which fingerprints may differ that are linked by segment tables.
DISTANCE = 3
#: Longs of a set's parity bits.
FLIPS = 4


def shingles_of(text: str | None, words: int = WORDS):
    """128 bits that name the words of a text (two numbers), and the distinct hashes of its shingles (all words of a shorter text; none of an empty one)."""
    import numpy as np
    import xxhash

    digest = xxhash.xxh64_intdigest
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    line = b" ".join(found)
    name = xxhash.xxh128_intdigest(line, SEED)
    name = name >> 64, name & (1 << 64) - 1
    if len(found) <= words:
        return name, np.array([digest(line, SEED)] if found else [], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    a, b = starts[: len(found) - words + 1].tolist(), ends[words - 1 :].tolist()
    return name, np.unique(np.fromiter((digest(line[i:j], SEED) for i, j in zip(a, b)), np.uint64, len(a)))


def band_keys(hashes, factors, terms) -> list[int]:
    """A key for each band of the MinHash values of a set; none of an empty one."""
    import numpy as np
    import xxhash

    if not len(hashes):
        return []
    least = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 1024):
        np.minimum(least, (hashes[at : at + 1024, None] * factors + terms).min(0), out=least)
    return [xxhash.xxh64_intdigest(least[i * VALUES : (i + 1) * VALUES].tobytes(), i) for i in range(BANDS)]


def _halves(names: list[tuple[int, int]]) -> list:
    import numpy as np
    import pyarrow as pa

    return [pa.array(np.array([n[i] for n in names], np.uint64).view(np.int64)) for i in (0, 1)]


def _prints(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, high and low (128 bits that name the words), n (shingles), fp (SimHash of the set) and keys of every row."""

    def work(batches: Iterator):
        import numpy as np
        import pyarrow as pa

        rng = np.random.default_rng(SEED)
        factors = rng.integers(0, 1 << 63, BANDS * VALUES, np.uint64) * np.uint64(2) + np.uint64(1)
        terms = rng.integers(0, 1 << 63, BANDS * VALUES, np.uint64)
        for batch in batches:
            for part in (batch.slice(i, 200) for i in range(0, len(batch), 200)):
                names, sizes, fps, keys = [], [], [], []
                for text in part.column(1).to_pylist():
                    name, hashes = shingles_of(text, words)
                    names.append(name)
                    sizes.append(len(hashes))
                    fps.append(majority(hashes))
                    keys.append(np.array(band_keys(hashes, factors, terms), np.uint64).view(np.int64))
                yield pa.RecordBatch.from_arrays([part.column(0), *_halves(names), pa.array(sizes, pa.int32()), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "high", "low", "n", "fp", "keys"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(work, f"doc_id {kind}, high long, low long, n int, fp long, keys array<long>")


def _sets(docs: DataFrame, words: int) -> DataFrame:
    """high, low and shingles of every row."""

    def work(batches: Iterator):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for part in (batch.slice(i, 200) for i in range(0, len(batch), 200)):
                found = [shingles_of(text, words) for text in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([*_halves([n for n, _ in found]), pa.array([h.view(np.int64) for _, h in found], pa.list_(pa.int64()))], ["high", "low", "shingles"])

    return docs.mapInArrow(work, "high long, low long, shingles array<long>")


def _fits(a: Column, b: Column) -> Column:
    """Whether sets of these sizes can be similar enough."""
    return F.least(a, b) * UNDER >= F.greatest(a, b) * OVER


def _similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of the pairs (a, b), those whose sets are similar enough; either side may have hot nodes."""
    total = pairs.count()
    for side, name in (("a", "x"), ("b", "y")):
        many = pairs.groupBy(side).agg(F.count(F.lit(1)).alias("many"))
        own = cut(many.join(sets.select(F.col("node").alias(side), F.col("shingles").alias(name)), side), "held")
        pairs = lookup(pairs, own, side, "many", total).drop("many")
    both = F.size(F.array_intersect("x", "y"))
    # both / (x + y - both) >= OVER / UNDER
    return pairs.where(both * (OVER + UNDER) >= (F.size("x") + F.size("y")) * OVER).select("a", "b")


def _ordered(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _flipped(k: int) -> Column:
    """The ``k``-th 64 bits of a set's parity: each shingle flips one bit of the whole."""
    one = lambda h: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(h, 2).bitwiseAND(F.lit(63).cast("long")).cast("int"))
    mine = F.filter("shingles", lambda h: h.bitwiseAND(F.lit(FLIPS - 1).cast("long")) == k)
    return F.aggregate(mine, F.lit(0).cast("long"), lambda a, h: a.bitwiseXOR(one(h)))


MARKS = [f"b{k}" for k in range(FLIPS)]


def _near_bits(p: str, q: str) -> Column:
    """Whether the parity bits of two sets, named with these prefixes, and their sizes leave them similar; true of all similar ones."""
    differ = sum((F.bit_count(F.col(p + b).bitwiseXOR(F.col(q + b))) for b in MARKS), F.lit(0))
    return differ * (OVER + UNDER) <= (F.col(p + "n") + F.col(q + "n")) * (UNDER - OVER)


def prefix_pairs(nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes of different roots, among them all whose sets are similar enough.

    Shingles are put in one order, the rarest among these sets first.  Sets of
    m and n shingles that are similar share (m + n) OVER / (OVER + UNDER); so
    from the first that they share, each has as many left.  That leaves the
    smaller one a ninth of its shingles to have it in, the larger one a fifth.
    Besides, each shingle flips one of 256 bits of its set: two sets differ in
    at least as many shingles as bits, and similar ones in no more than a ninth
    of m + n.  Neither test loses a similar pair.
    """
    bits = [_flipped(k).alias(b) for k, b in enumerate(MARKS)]
    own = cut(sets.join(nodes, "node").select("node", "root", F.size("shingles").alias("n"), *bits, "shingles"), "apart_sets")
    each = own.select("node", F.explode("shingles").alias("w"))
    often = cut(each.groupBy("w").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "often")
    # Only shared shingles are put in order; those that no other set has come before them all.
    placed = each.join(often, "w").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("df", "w"))).alias("ws")).join(own.drop("shingles"), "node")
    least = F.ceil(F.col("n") * OVER / UNDER)  # what any similar set shares with it
    ahead = F.col("n") - F.size("ws")
    placed = placed.select("node", "root", "n", *MARKS, ahead.alias("ahead"), F.posexplode(F.slice("ws", F.lit(1), F.greatest(F.lit(0), F.col("n") - least + 1 - ahead).cast("int"))).alias("at", "s"))
    placed = cut(placed.select("node", "root", "n", *MARKS, F.col("s.w").alias("w"), (F.col("n") - F.col("ahead") - F.col("at")).alias("left")), "prefixes")
    small, large = placed.where(F.col("left") * (OVER + UNDER) >= F.col("n") * 2 * OVER).alias("p"), placed.alias("q")
    most = F.least("p.left", "q.left") * (OVER + UNDER) >= (F.col("p.n") + F.col("q.n")) * OVER
    most = most & _near_bits("p.", "q.")
    met = small.join(large, (F.col("p.w") == F.col("q.w")) & (F.col("p.root") != F.col("q.root")) & (F.col("p.n") <= F.col("q.n")) & most)
    return met.select(*_ordered(F.col("p.node"), F.col("q.node")))


def _alike(classes: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes by their fingerprints (node, fp, n): one for each node at most, so a crowd makes no more.

    Nodes of one fingerprint are held against the least of them, and this
    against that of the least fingerprint that its own is linked to.
    """
    some = classes.where("n > 0").select("node", "fp", "n")
    heads = cut(some.groupBy("fp").agg(F.min(F.struct("node", "n")).alias("head"), F.count(F.lit(1)).alias("many")), "alike_heads")
    head = heads.select("fp", "head")
    near = cut(links(heads.select("fp"), DISTANCE).groupBy("a").agg(F.min("b").alias("b")), "near")
    apart = near.join(head.select(F.col("fp").alias("a"), F.col("head").alias("x")), "a").join(head.select(F.col("fp").alias("b"), F.col("head").alias("y")), "b").where(_fits(F.col("x.n"), F.col("y.n")))
    same = lookup(some, heads.where("many > 1"), "fp", "many", some.count()).where((F.col("node") != F.col("head.node")) & _fits(F.col("n"), F.col("head.n")))
    return cut(apart.select(*_ordered(F.col("x.node"), F.col("y.node"))).unionByName(same.select(*_ordered(F.col("node"), F.col("head.node")))).distinct(), "alike")


def _edges(met: DataFrame, sets: DataFrame, alike: DataFrame) -> DataFrame:
    """Similar pairs that connect what all similar pairs under one key, and those of ``alike``, do.

    ``met`` has key, node, n and parity bits of the keys that several nodes have.
    """
    edges, tried, rest = None, None, met.withColumn("root", F.col("node"))
    for turn in range(-1, STARS + 1):
        if turn < 0:
            pairs = alike
        elif turn < STARS:
            total = rest.count()
            first = F.min_by(F.struct("node", "root", "n", *MARKS), F.struct(F.xxhash64("node", F.lit(turn)), "node"))
            heads = cut(rest.groupBy("key").agg(first.alias("head"), F.count(F.lit(1)).alias("many")), "heads")
            pairs = lookup(rest, heads, "key", "many", total).where((F.col("root") != F.col("head.root")) & _fits(F.col("n"), F.col("head.n")) & _near_bits("", "head."))
            pairs = pairs.select(*_ordered(F.col("node"), F.col("head.node")))
        else:
            pairs = prefix_pairs(rest.select("node", "root").distinct(), sets)
        pairs = pairs.distinct()
        pairs = cut(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"), "pairs")
        tried = pairs if tried is None else tried.unionByName(pairs)
        found = cut(_similar(pairs, sets), "similar")
        edges = found if edges is None else edges.unionByName(found)
        if turn == STARS:
            break
        roots = components(edges)
        told = rest.drop("root").join(roots, "node", "left").select("key", "node", "n", *MARKS, F.coalesce("root", "node").alias("root"))
        told = cut(told, "told")
        apart = told.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("many")).where("low <> high").select("key", "many")
        rest = cut(lookup(told, cut(apart, "apart"), "key", "many", told.count()).where("many is not null").drop("many"), "rest")
        if not rest.limit(1).count():
            break
    return edges


def groups(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id and component_id (the smallest doc_id of the group) of every row of ``docs`` (doc_id, text).

    Null texts and texts without a word are all alike.  Rows with a null
    doc_id lend their group no id.  Repeated rows stay as they are.  Very long
    texts are compared by all their shingles.  No rows give none.  Other
    columns are ignored, whatever their names.
    """
    own = columns_apart(docs, "doc_id", "text")
    prints = cut(_prints(own, words), "prints")
    classes = prints.groupBy("high", "low").agg(F.min("doc_id").alias("least"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("keys").alias("keys"), F.count(F.lit(1)).alias("many"))
    classes = cut(classes.withColumn("node", F.monotonically_increasing_id()), "classes")  # numbers stay as written
    filed = classes.select("node", "n", F.explode("keys").alias("key"))
    shared = cut(filed.groupBy("key").agg(F.count(F.lit(1)).alias("many")).where("many > 1"), "shared")
    hint = F.broadcast if bounded(shared, SMALL) else (lambda df: df)
    met = cut(filed.join(hint(shared), "key").select("key", "node", "n"), "met")
    alike = _alike(classes)
    seen = met.select("node").unionByName(alike.select(F.col("a").alias("node"))).unionByName(alike.select(F.col("b").alias("node")))
    nodes = cut(seen.distinct().join(classes, "node").select("node", "high", "low", "least"), "nodes")
    ids = cut(nodes.select("least").distinct(), "ids")
    if bounded(ids, SMALL):
        nodes, ids = F.broadcast(nodes), F.broadcast(ids)
    texts = own.join(ids, F.col("doc_id").eqNullSafe(F.col("least")), "left_semi")
    sets = cut(_sets(texts, words).join(nodes.select("node", "high", "low"), ["high", "low"]).select("node", "shingles").dropDuplicates(["node"]), "sets")
    marks = sets.select("node", *[_flipped(k).alias(b) for k, b in enumerate(MARKS)])
    met = cut(met.join(marks, "node"), "marked")
    reach = cut(components(_edges(met, sets, alike)), "reach")
    of = cut(classes.select("node", "high", "low", "many", "least").join(reach, "node", "left").withColumn("root", F.coalesce("root", "node")), "roots")
    named = of.groupBy("root").agg(F.min("least").alias("component_id"))
    # A group's classes, and a class's rows, may be many: both are joined by lookup.
    weighed = of.groupBy("root").agg(F.count(F.lit(1)).alias("classes"))
    named = lookup(of, cut(named.join(weighed, "root"), "named"), "root", "classes", of.count())
    name = F.struct("high", "low").alias("name")
    named = cut(named.select(name, "many", "component_id"), "components")
    return lookup(prints.select("doc_id", name), named, "name", "many", prints.count()).select("doc_id", "component_id")


def keep_one(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """``docs`` without the rows that have a smaller doc_id in their group.

    Rows with a null doc_id, which nothing can name, stay, and so do rows that
    repeat a doc_id that stays.  All columns stay, whatever their names; no
    rows give none.
    """
    gone = groups(docs, words).where("doc_id > component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
