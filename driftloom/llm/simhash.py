"""SimHash near-duplicates by multi-index hashing.

Fingerprints are filed in one table for each of their segments, by the value
of that segment.  Each looks up the small Hamming ball around its own value in
each table, and what it meets there is verified by the complete distance.  A
pair within the distance is in some segment as near as that ball is wide, so
none is missed.  Where so many fingerprints share a segment that pairs would
grow with the square, they are linked through the values between them instead.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, columns_apart, cut

#: Seed of the XXH64 of a shingle.
SEED = 42
#: Segments of a fingerprint; fingerprints that share a segment before pairs of them are not looked at; rows up to which a table is broadcast.
SEGMENTS, HOT, SMALL = 2, 64, 100_000


def majority(hashes) -> int:
    """The number whose bits are set in over half the hashes; zero of none."""
    import numpy as np

    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 8192):
        part = hashes[at : at + 8192].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return sum(1 << int(i) for i in np.flatnonzero(2 * ones > len(hashes)))


def fingerprints_of(texts, words: int = 3) -> list[int]:
    """SimHash of each text, unsigned; the plain statement is in the tests."""
    import numpy as np
    import xxhash

    digest, out = xxhash.xxh64_intdigest, []
    for text in texts:
        found = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if not found:
            out.append(0)
            continue
        if len(found) <= words:
            hashes = np.array([digest(b" ".join(found), SEED)], np.uint64)
        else:
            line = b" ".join(found)
            ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
            starts = np.concatenate(([0], ends[:-1] + 1))
            a, b = starts[: len(found) - words + 1].tolist(), ends[words - 1 :].tolist()
            hashes = np.fromiter((digest(line[i:j], SEED) for i, j in zip(a, b)), np.uint64, len(a))
        out.append(majority(hashes))
    return out


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of every row."""

    def work(batches: Iterator):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for part in (batch.slice(i, 200) for i in range(0, len(batch), 200)):
                own = np.array(fingerprints_of(part.column(1).to_pylist(), words), np.uint64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(own.view(np.int64))], ["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return columns_apart(docs, "doc_id", "text").mapInArrow(work, f"doc_id {kind}, fp long")


def _bit(i: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), i)


def masks(bits: int, radius: int) -> list[int]:
    """All numbers of ``bits`` bits with at most ``radius`` ones, as signed longs."""
    found = [sum(1 << i for i in some) for n in range(radius + 1) for some in combinations(range(bits), n)]
    return [m - (1 << 64) if m >> 63 else m for m in found]


def _ball(value: Column, bits: int, radius: int) -> Column:
    """Array of the values within ``radius`` bits; larger radii are small ones once more."""
    if radius == 0:
        return F.array(value)
    some = F.array(*[F.lit(m).cast("long") for m in masks(bits, min(radius, 1))])
    if radius == 1:
        return F.transform(some, lambda m: value.bitwiseXOR(m))
    return F.array_distinct(F.flatten(F.transform(some, lambda m: _ball(value.bitwiseXOR(m), bits, radius - 1))))


def segments(fp: Column, count: int) -> Column:
    """Array of (segment, value): the fingerprint's bits cut into ``count`` even runs; the table's number is in the top bits."""
    wide = 64 // count
    one = lambda i: F.call_function("shiftrightunsigned", fp, F.lit(i * wide)).bitwiseAND(F.lit((1 << wide) - 1))
    return F.array(*[F.struct(F.lit(i).alias("segment"), one(i).alias("value")) for i in range(count)])


def _key(segment: Column, value: Column, count: int) -> Column:
    """The place of a value in the tables of all segments, as one number."""
    return value * F.lit(count) + segment


def links(prints: DataFrame, distance: int = 2, count: int = SEGMENTS, hot: int = HOT) -> DataFrame:
    """Edges (a, b) that connect distinct values ``fp`` as all links do.

    A table for each of ``count`` segments files the fingerprints by the value
    of that segment.  Two that differ in ``distance`` bits differ in at most
    ``distance`` // ``count`` of some segment, so each looks up the values in
    that small ball, in each table, and the whole distance of what it meets is
    verified.  Values near one that over ``hot`` fingerprints have would make
    many candidates; what only they connect is found by ``stars``.
    """
    if distance < 1 or count not in (2, 4):
        raise ValueError("a distance of 1 or more, and 2 or 4 segments")
    radius, wide = distance // count, 64 // count
    each = prints.select("fp", F.inline(segments(F.col("fp"), count)))
    filed = each.select("fp", _key(F.col("segment"), F.col("value"), count).alias("key"))
    probes = each.select("fp", "segment", F.explode(_ball(F.col("value"), wide, radius)).alias("value")).select(F.col("fp").alias("a"), _key(F.col("segment"), F.col("value"), count).alias("key"))
    heavy = cut(filed.groupBy("key").agg(F.count(F.lit(1)).alias("many")).where(F.col("many") > hot).select("key"), "heavy")
    crowded = heavy.limit(1).count() > 0
    if crowded:
        value = F.floor(F.col("key") / count).cast("long")
        near = heavy.select((F.col("key") % count).alias("segment"), F.explode(_ball(value, wide, radius)).alias("value"))
        near = cut(near.select(_key(F.col("segment"), F.col("value"), count).alias("key")).distinct(), "crowded")
        hint = F.broadcast if bounded(near, SMALL) else (lambda df: df)
        inside = cut(filed.join(hint(near), "key", "left_semi").select("fp").distinct(), "inside")
        filed = filed.join(hint(near), "key", "left_anti")
    met = probes.join(filed.select("key", F.col("fp").alias("b")), "key").select("a", "b")
    found = met.where((F.col("a") != F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance))
    found = found.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    if crowded:
        found = found.unionByName(stars(inside, distance))
    return found.distinct()


def stars(prints: DataFrame, distance: int) -> DataFrame:
    """Edges (a, b) that connect values ``fp`` as all links do, without pairs.

    Two within ``distance`` bits have a value between them that is within half
    the distance, rounded down, of one and, rounded up, of the other.  All
    that are near a value in this way are linked to the least of the nearer
    ones; these are within ``distance`` of it.  A value has no more such
    neighbours than its ball has members, however many fingerprints there are.
    """
    near, far = distance // 2, distance - distance // 2
    ball = prints.select("fp", F.explode(_ball(F.col("fp"), 64, far)).alias("mid"))
    inner = F.when(F.bit_count(F.col("fp").bitwiseXOR(F.col("mid"))) <= near, F.col("fp"))
    around = ball.groupBy("mid").agg(F.min(inner).alias("b"), F.collect_list("fp").alias("m")).where("b is not null and size(m) > 1")
    return around.select(F.explode("m").alias("a"), "b").where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root: the smallest node that each node reaches, by label passing.

    Each round takes the smallest label of the neighbours, then that label's
    own label, so the rounds grow with the logarithm of the longest path.
    Joins are by plain exchanges that Spark may split where a node is hot.
    """
    both = cut(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v"))), "links")
    labels = cut(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.col("u")).alias("root")), "labels")
    while True:
        offers = both.join(labels.select(F.col("node").alias("u"), "root"), "u").select(F.col("v").alias("node"), "root", F.lit(None).cast("long").alias("old"))
        known = labels.select("node", "root", F.col("root").alias("old"))
        least = cut(offers.unionByName(known).groupBy("node").agg(F.min("root").alias("root"), F.max("old").alias("old")), "least")
        jump = least.select(F.col("node").alias("root"), F.col("root").alias("far"))
        labels = cut(least.join(jump, "root", "left").select("node", F.least("root", "far").alias("root"), "old"), "labels")
        if not labels.where("root < old").limit(1).count():
            return labels.select("node", "root")


def near_duplicates(docs: DataFrame, words: int = 3, distance: int = 2) -> DataFrame:
    """doc_id, fp, component_id of every row of ``docs`` (doc_id, text).

    Texts that are null or have no word get fingerprint zero and link like any
    other.  Rows with a null doc_id are kept; they lend their component no id.
    Repeated rows stay as they are.  Very long texts give all their shingles.
    No rows give none.  Columns besides doc_id and text are ignored, whatever
    their names.
    """
    prints = cut(fingerprints(docs, words), "prints")
    classes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    reach = components(links(classes, distance))
    of = classes.join(reach.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    of = cut(of, "roots")
    ids = of.groupBy("root").agg(F.min("least").alias("component_id"))
    ids = cut(of.join(cut(ids, "ids"), "root").select("fp", "component_id"), "components")
    return prints.join(ids, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, words: int = 3, distance: int = 2) -> DataFrame:
    """``docs`` without the rows that have a smaller doc_id in their component.

    Rows with a null doc_id, which nothing can name, stay.  Null and empty texts
    are one component, very long ones are compared whole.  All columns stay,
    whatever their names.  No rows give none.
    """
    gone = near_duplicates(docs, words, distance).where("doc_id > component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
