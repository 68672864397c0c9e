"""Values at exact places of an order, without one task that sorts them all."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written

#: Values that one task may sort for a place.
SORTED = 100_000
#: Shares that a sketch of a group's values is asked for, and its accuracy.
GRID, ACCURACY = 100, 10_000


def values_at(df: DataFrame, value: str, by: tuple[str, ...], at: dict[str, Callable[[Column], Column]], most: int = SORTED) -> DataFrame:
    """by, n and, for each name in ``at``, the value at that index (from 0, a function of n) in the order of values.

    A mergeable sketch of each group tells two values that a place lies
    between, however the values are spread.  What is below is counted, and only
    the distinct values between are counted one by one; while these are more
    than ``most``, they are cut at shares of their own.  A sketch that is wrong
    costs another round, never the result.  Nulls and NaN don't count; a group
    without values has no row.
    """
    key = F.struct(*by) if by else F.struct(F.lit(1).alias("one"))
    v = F.col(value).cast("double")
    rows = written(df.where(v.isNotNull() & ~F.isnan(v)).select(key.alias("g"), v.alias("v")), "values")
    wanted = lambda n: F.array(*[F.struct(F.lit(k).alias("name"), f(n).cast("long").alias("index")) for k, f in at.items()])
    if rows.count() <= most:
        sizes = rows.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
        places = sizes.select("g", F.explode(wanted(F.col("n"))).alias("w")).select("g", "w.name", F.col("w.index").alias("offset"))
        found = _chosen(rows.groupBy("g", "v").agg(F.count(F.lit(1)).alias("c")).join(places, "g"))
    else:
        sizes, found = _by_sketch(rows, wanted, list(at), most)
    one = found.groupBy("g").agg(*[F.max(F.when(F.col("name") == k, F.col("v"))).alias(k) for k in at])
    return sizes.select("g", "n").join(one, "g").select(*[F.col(f"g.`{b}`").alias(b) for b in by], "n", *at)


def _shares() -> Column:
    return F.array(*[F.lit(i / GRID) for i in range(GRID + 1)])


def _by_sketch(rows: DataFrame, wanted: Callable, names: list[str], most: int) -> tuple[DataFrame, DataFrame]:
    sketch = rows.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("v", _shares(), ACCURACY).alias("q"))
    share = lambda w, off: (w["index"] / F.col("n") + F.lit(off)) * GRID
    edges = lambda w: F.struct(
        w["name"].alias("name"), w["index"].alias("index"),
        F.get("q", F.greatest(F.lit(0), F.floor(share(w, -2 / ACCURACY))).cast("int")).alias("low"),
        F.get("q", F.least(F.lit(GRID), F.ceil(share(w, 2 / ACCURACY))).cast("int")).alias("high"),
    )
    sizes = written(sketch.select("g", "n", F.transform(wanted(F.col("n")), edges).alias("places")), "brackets")
    placed = rows.join(sizes.select("g", "places"), "g")
    # What is below each bracket and in it, from one row a value whatever the number of places.
    below = [F.count_if(F.col("v") < F.get("places", i)["low"]).alias(f"b{i}") for i in range(len(names))]
    within = [F.count_if(F.col("v").between(F.get("places", i)["low"], F.get("places", i)["high"])).alias(f"m{i}") for i in range(len(names))]
    told = placed.groupBy("g").agg(F.first("places").alias("places"), *below, *within)
    each = F.array(*[F.struct(F.get("places", i).alias("p"), F.col(f"b{i}").alias("b"), F.col(f"m{i}").alias("m")) for i in range(len(names))])
    # A place outside its bracket is looked for on that side of it.
    low = F.when(F.col("x.p.index") < F.col("x.b"), F.lit(float("-inf"))).when(F.col("x.p.index") >= F.col("x.b") + F.col("x.m"), F.col("x.p.high")).otherwise(F.col("x.p.low"))
    high = F.when(F.col("x.p.index") < F.col("x.b"), F.col("x.p.low")).when(F.col("x.p.index") >= F.col("x.b") + F.col("x.m"), F.lit(float("inf"))).otherwise(F.col("x.p.high"))
    wrong = (F.col("x.p.index") < F.col("x.b")) | (F.col("x.p.index") >= F.col("x.b") + F.col("x.m"))
    ranges = told.select("g", F.explode(each).alias("x")).select("g", F.col("x.p.name").alias("name"), F.col("x.p.index").alias("index"), low.alias("low"), high.alias("high"), wrong.alias("wrong"), F.col("x.b").alias("below"))
    ranges = written(ranges, "ranges")
    lists = ranges.groupBy("g").agg(F.collect_list(F.struct("name", "low", "high")).alias("ranges"))
    inside = rows.join(lists, "g").select("g", "v", F.explode(F.filter("ranges", lambda r: F.col("v").between(r["low"], r["high"]))).alias("r"))
    counted = written(inside.groupBy("g", F.col("r.name").alias("name"), "v").agg(F.count(F.lit(1)).alias("c")), "counted")
    # Values below a range that was looked for anew are counted anew.
    if ranges.where("wrong").limit(1).count():
        moved = rows.join(ranges, "g").groupBy("g", "name").agg(F.first("index").alias("index"), F.count_if(F.col("v") < F.col("low")).alias("below"))
    else:
        moved = ranges.select("g", "name", "index", "below")
    places = written(moved.select("g", "name", (F.col("index") - F.col("below")).alias("offset")), "places")
    return sizes, _chosen(_narrowed(counted, places, most))


def _narrowed(counted: DataFrame, places: DataFrame, most: int) -> DataFrame:
    """g, name, v, c, offset of few enough values for each place: cut at shares of the distinct values until they are."""
    while True:
        sizes = counted.groupBy("g", "name").agg(F.count(F.lit(1)).alias("d"))
        if not sizes.where(F.col("d") > most).limit(1).count():
            return counted.join(places, ["g", "name"])
        cuts = counted.groupBy("g", "name").agg(F.array_distinct(F.percentile_approx("v", _shares(), ACCURACY)).alias("q"))
        cell = F.size(F.filter("q", lambda x: x <= F.col("v")))
        celled = written(counted.join(cuts, ["g", "name"]).select("g", "name", "v", "c", cell.alias("cell")), "cells")
        order = Window.partitionBy("g", "name").orderBy("cell")
        cells = celled.groupBy("g", "name", "cell").agg(F.sum("c").alias("m")).withColumn("start", F.sum("m").over(order) - F.col("m"))
        chosen = cells.join(places, ["g", "name"]).where((F.col("offset") >= F.col("start")) & (F.col("offset") < F.col("start") + F.col("m")))
        chosen = written(chosen.select("g", "name", "cell", (F.col("offset") - F.col("start")).alias("offset")), "chosen")
        places = chosen.select("g", "name", "offset")
        counted = written(celled.join(chosen.select("g", "name", "cell"), ["g", "name", "cell"]).select("g", "name", "v", "c"), "counted")


def _chosen(rows: DataFrame) -> DataFrame:
    """g, name, v: of (g, name, v, c, offset) the value that the offset is in."""
    upto = F.sum("c").over(Window.partitionBy("g", "name").orderBy("v"))
    return rows.withColumn("upto", upto).where((F.col("upto") > F.col("offset")) & (F.col("upto") - F.col("c") <= F.col("offset"))).select("g", "name", "v")


def percentile(df: DataFrame, value: str, share: float, name: str = "value", *by: str) -> DataFrame:
    """by, n and the interpolated percentile of a value, as ``name``."""
    at = lambda n: (n - 1) * F.lit(float(share))
    rows = values_at(df, value, by, {"_low": lambda n: F.floor(at(n)), "_high": lambda n: F.ceil(at(n))})
    part = at(F.col("n")) - F.floor(at(F.col("n")))
    return rows.select(*by, "n", (F.col("_low") + (F.col("_high") - F.col("_low")) * part).alias(name))
