"""Evaluation: accuracy, agreement, sweeps, label resolution and sampling, as queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import reason_signal
from ..functions.vectors import ratio
from .inject import draw
from .places import values_at
from .steps import by_run

#: Parts of a stratum that are ranked apart.
PARTS = 64
#: Items of a piece that one task puts in order.
PIECE = 100_000


def first_flagged(signals: DataFrame, flag: str = "flagged") -> DataFrame:
    """run_id, predicted: the earliest flagged ordinal, null where there is none."""
    return signals.groupBy("run_id").agg(F.min(F.when(F.col(flag), F.col("ordinal"))).alias("predicted"))


def accuracy(pairs: DataFrame, *by: str) -> DataFrame:
    """n, exact, within1 of (predicted, actual); no prediction is a miss."""
    hit = lambda c: F.avg(F.coalesce(c, F.lit(False)).cast("double"))
    return pairs.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), hit(F.col("predicted") == F.col("actual")).alias("exact"), hit(F.abs(F.col("predicted") - F.col("actual")) <= 1).alias("within1"))


def rates(runs: DataFrame, fired: str, truth: str, *by: str) -> DataFrame:
    """How many true and clean runs there are, and in how many of each something fired."""
    return runs.groupBy(*by).agg(
        F.count_if(F.col(truth)).alias("n_true"), F.count_if(F.col(truth) & F.col(fired)).alias("recall"),
        F.count_if(~F.col(truth)).alias("n_clean"), F.count_if(~F.col(truth) & F.col(fired)).alias("false_alarms"),
    )


def index_quantiles(df: DataFrame, value: str, *by: str) -> DataFrame:
    """Least, first quarter, middle and largest value, each one that occurs."""
    at = {"low": lambda n: F.lit(0), "p25": lambda n: F.floor(n * 0.25), "middle": lambda n: F.floor(n * 0.5), "high": lambda n: n - 1}
    return values_at(df, value, by, at).drop("n")


def distribution(df: DataFrame, category: str, *subsets: str) -> DataFrame:
    """Counts of a category for all rows and for each subset, with its share."""
    sets = [[F.col(category)], *[[F.col(category), F.col(s)] for s in subsets]]
    rows = df.groupingSets(sets, category, *subsets).agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("grouping"))
    return rows.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("grouping", *subsets)))


def kappa(df: DataFrame, a: str, b: str) -> DataFrame:
    """n, observed, expected, kappa of two raters; null below two rows or where chance explains all."""
    cells = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    totals = cells.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("same"))
    sides = cells.groupBy(F.col("a").alias("k")).agg(F.sum("n").alias("na")).join(cells.groupBy(F.col("b").alias("k")).agg(F.sum("n").alias("nb")), "k")
    chance = sides.agg(F.coalesce(F.sum(F.col("na") * F.col("nb")), F.lit(0)).alias("products"))
    row = totals.crossJoin(chance).select("n", ratio(F.col("same"), F.col("n")).alias("observed"), ratio(F.col("products"), F.col("n") * F.col("n")).alias("expected"))
    return row.withColumn("kappa", F.when((F.col("n") >= 2) & (F.col("expected") < 1), (F.col("observed") - F.col("expected")) / (1 - F.col("expected"))))


def within_one(a: Column, b: Column) -> Column:
    """Two steps agree if at most one apart; two nulls agree, one does not."""
    return F.coalesce(F.abs(a - b) <= 1, a.isNull() & b.isNull())


def rater_pairs(labels: DataFrame, basis: DataFrame | None = None) -> DataFrame:
    """All pairs of raters over the items both labelled (item_id, rater, label), only items of ``basis`` if given."""
    own = labels if basis is None else labels.join(basis.select("item_id"), "item_id", "left_semi")
    a, b = own.alias("a"), own.alias("b")
    return a.join(b, (F.col("a.item_id") == F.col("b.item_id")) & (F.col("a.rater") < F.col("b.rater"))).select("a.item_id", F.col("a.rater").alias("rater_a"), F.col("b.rater").alias("rater_b"), F.col("a.label").alias("label_a"), F.col("b.label").alias("label_b"))


def signal_counts(signals: DataFrame) -> DataFrame:
    """signal, n: how many steps each signal flags, one count a step."""
    each = signals.select(F.explode(F.array_distinct(F.transform("flag_reasons", reason_signal))).alias("signal"))
    return each.groupBy("signal").agg(F.count(F.lit(1)).alias("n"))


def most_common(counts: DataFrame, category: str, n: str = "n") -> DataFrame:
    """``counts`` with ``place``: 1 for the most frequent category, equals by name; the categories are few."""
    return counts.withColumn("place", F.row_number().over(Window.orderBy(F.desc(n), category)))


def consecutive_flags(signals: DataFrame) -> DataFrame:
    """run_id, consecutive: whether two steps in a row are flagged."""
    pairs = signals.withColumn("pair", F.col("flagged") & F.coalesce(F.lead("flagged").over(by_run()), F.lit(False)))
    return pairs.groupBy("run_id").agg(F.bool_or("pair").alias("consecutive"))


def ablation(signals: DataFrame, drift: float, aggregate: float) -> DataFrame:
    """Which variants of the detector fire in each run."""
    return signals.groupBy("run_id").agg(*variants(drift, aggregate))


def variants(drift: float, aggregate: float) -> list[Column]:
    """Which variants of the detector fire: aggregations of a run's signals."""
    over = lambda c, t: F.coalesce(F.bool_or(F.col(c) > t), F.lit(False))
    prev, anchor = over("drift_prev", drift), over("drift_anchor", drift)
    return [prev.alias("prev"), anchor.alias("anchor"), (prev | anchor).alias("dual"), over("aggregate", aggregate).alias("dual_nli")]


def naive_baseline(first_last: DataFrame, threshold: float) -> DataFrame:
    """run_id, naive: whether the last step's distance from the first (``drift_anchor``) is over the threshold."""
    last = first_last.groupBy("run_id").agg(F.max_by("drift_anchor", "ordinal").alias("distance"))
    return last.select("run_id", "distance", F.coalesce(F.col("distance") > threshold, F.lit(False)).alias("naive"))


# Which type each injected kind should be told as.
EXPECTED = {
    "numeric_fabrication": "inference", "entity_distortion": "context_poisoning", "causal_leap": "inference",
    "certainty_inflation": "confidence_inflation", "context_swap": "context_poisoning",
}


def detection_table(runs: DataFrame) -> DataFrame:
    """By kind and for all: how often each variant detects, and of the detected runs the shares with the right step, type or nearly.

    ``runs`` has kind, dual_nli (detected), prev, anchor, dual, naive,
    predicted, actual and types (array).
    """
    expected = F.element_at(F.create_map(*[F.lit(x) for kv in EXPECTED.items() for x in kv]), F.col("kind"))
    rows = runs.withColumn("right", F.array_contains("types", expected))
    share = lambda c: F.avg(F.when(F.col("dual_nli"), F.coalesce(c, F.lit(False)).cast("double")))
    found = rows.groupingSets([[F.col("kind")], []], "kind").agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(F.col(v).cast("double")).alias(v) for v in ("dual_nli", "dual", "prev", "anchor", "naive")],
        share(F.col("predicted") == F.col("actual")).alias("exact"), share(F.abs(F.col("predicted") - F.col("actual")) <= 1).alias("within1"),
        share(F.col("right")).alias("right_type"),
    )
    return found.withColumn("kind", F.coalesce("kind", F.lit("total")))


def omission_effect(signals: DataFrame, truth: DataFrame) -> DataFrame:
    """What the omission signal changes: first flags without and with it, against (run_id, truth, origin).

    One row: how many true runs, in how many of them each has a flag, the
    right step or nearly; clean runs that fire; runs whose only flag is an
    omission; runs where it moves the first flag closer to the origin.
    """
    plain = F.size(F.filter("flag_codes", lambda c: c != "omission")) > 0
    firsts = signals.groupBy("run_id").agg(F.min(F.when(plain, F.col("ordinal"))).alias("without"), F.min(F.when(F.col("flagged"), F.col("ordinal"))).alias("with"))
    rows = firsts.join(truth, "run_id")
    true, off = F.col("truth"), lambda c: F.abs(F.col(c) - F.col("origin"))
    each = []
    for c in ("without", "with"):
        each += [
            F.count_if(true & F.col(c).isNotNull()).alias(f"found_{c}"), F.count_if(true & (off(c) == 0)).alias(f"exact_{c}"),
            F.count_if(true & (off(c) <= 1)).alias(f"within1_{c}"), F.count_if(~true & F.col(c).isNotNull()).alias(f"clean_{c}"),
        ]
    return rows.agg(
        F.count_if(true).alias("n"), F.count_if(~true).alias("n_clean"), *each,
        F.count_if(true & F.col("without").isNull() & F.col("with").isNotNull()).alias("gained"), F.count_if(true & (off("with") < off("without"))).alias("improved"),
    )


def rescored(runs: DataFrame, truths: DataFrame, cover: float, omit: float) -> DataFrame:
    """First flags from stored scores, without and with omission, against several sets of labels.

    ``runs`` is as for ``threshold_sweep``, without truth; ``truths`` is
    (run_id, basis, truth, origin).  Rows: basis, omission, n, exact, within1;
    runs that are not true don't count.
    """
    covered = F.transform("matrix", lambda r: F.when(F.size(r) > 0, F.size(F.filter(r, lambda x: x >= cover)) / F.size(r)).otherwise(0.0))
    rows = runs.withColumn("covered", covered)
    lost = F.transform("covered", lambda c, i: F.greatest(F.lit(0.0), F.when(i == 0, F.lit(1.0)).otherwise(F.get("covered", i - 1)) - c))
    both = F.zip_with("flagged", lost, lambda f, x: f | (x > omit))
    first = lambda on: F.when(F.array_contains(on, True), F.get("step_ids", (F.array_position(on, True) - 1).cast("int")))
    told = F.array(F.struct(F.lit(False).alias("omission"), first(F.col("flagged")).alias("predicted")), F.struct(F.lit(True).alias("omission"), first(both).alias("predicted")))
    rows = rows.select("run_id", F.inline(told)).join(truths.where("truth").select("run_id", "basis", F.col("origin").alias("actual")), "run_id")
    return accuracy(rows, "basis", "omission")


def threshold_sweep(runs: DataFrame, coverages: list[float], omissions: list[float], skip_roles: tuple[str, ...] = ()) -> DataFrame:
    """Accuracy of the first flag and false alarms for every pair of thresholds, from stored scores.

    ``runs`` has run_id, truth (boolean), origin, step_ids, roles, flagged
    (arrays by step) and matrix: for each step the entailment of each fact.
    The grid is small and fixed, so it is broadcast.
    """
    grid = runs.sparkSession.createDataFrame([(c, o) for c in coverages for o in omissions], "cover double, omit double")
    rows = runs.where("size(matrix) > 0 and size(matrix[0]) > 0").crossJoin(F.broadcast(grid))
    covered = F.transform("matrix", lambda r: F.size(F.filter(r, lambda x: x >= F.col("cover"))) / F.size(r))
    rows = rows.withColumn("covered", covered)
    lost = F.transform("covered", lambda c, i: F.greatest(F.lit(0.0), F.when(i == 0, F.lit(1.0)).otherwise(F.get("covered", i - 1)) - c))
    quiet = lambda i: F.coalesce(F.lower(F.get("roles", i)).isin(*skip_roles), F.lit(False)) if skip_roles else F.lit(False)
    rows = rows.withColumn("lost", lost).withColumn("on", F.transform("flagged", lambda f, i: f | ((F.get("lost", i) > F.col("omit")) & ~quiet(i))))
    rows = rows.withColumn("first", F.get("step_ids", (F.array_position("on", True) - 1).cast("int"))).withColumn("first", F.when(F.array_contains("on", True), F.col("first")))
    hit = lambda c: F.avg(F.when(F.col("truth"), F.coalesce(c, F.lit(False)).cast("double")))
    on = F.size(F.filter("on", lambda x: x))
    return rows.groupBy("cover", "omit").agg(
        hit(F.col("first") == F.col("origin")).alias("exact"), hit(F.abs(F.col("first") - F.col("origin")) <= 1).alias("within1"),
        ratio(F.coalesce(F.sum(F.when(~F.col("truth"), on)), F.lit(0)), F.sum(F.when(~F.col("truth"), F.size("on")).otherwise(0)), F.lit(0.0)).alias("fp_steps"),
        F.count_if(~F.col("truth") & (on > 0)).alias("fp_runs"),
    )


def best_setting(sweep: DataFrame) -> DataFrame:
    """The setting that is nearest most often, then with the fewest false alarms, then with the larger thresholds."""
    return sweep.orderBy(F.desc("within1"), "fp_steps", F.desc("cover"), F.desc("omit")).limit(1)


def rule_sweep(runs: DataFrame, rules: list[tuple]) -> DataFrame:
    """Recall and false alarms of verdict rules (name, aggregate, entailment, drift, omission, consecutive).

    ``runs`` has truth and the extremes of each signal; a null level is off.
    """
    kinds = "rule string, r_aggregate double, r_entailment double, r_drift double, r_omission double, r_consecutive boolean"
    table = F.broadcast(runs.sparkSession.createDataFrame(rules, kinds))
    fires = [F.col("max_aggregate") > F.col("r_aggregate"), F.col("min_entailment") < F.col("r_entailment"), F.col("max_drift") > F.col("r_drift"), F.col("max_omission") > F.col("r_omission"), F.col("consecutive") & F.col("r_consecutive")]
    fired = reduce(lambda a, b: a | b, [F.coalesce(f, F.lit(False)) for f in fires])
    return rates(runs.crossJoin(table).withColumn("fired", fired), "fired", "truth", "rule")


def resolve_labels(humans: DataFrame, machine: DataFrame) -> DataFrame:
    """item_id, label, agreement of every item of ``machine`` (item_id, label).

    ``humans`` is (item_id, rater, label).  No human pass leaves the machine's;
    one is taken; two that agree are a consensus.  Where the first two raters
    by name differ, the one that agrees with the machine wins, and if none
    does the machine's label stands, unresolved.
    """
    passes = humans.where("label is not null").groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("rater", "label"))).alias("p"))
    rows = machine.select("item_id", F.col("label").alias("m")).join(passes, "item_id", "left")
    one, two, n = F.get("p", 0), F.get("p", 1), F.coalesce(F.size("p"), F.lit(0))
    winner = F.get(F.filter(F.slice("p", 1, 2), lambda p: p["label"] == F.col("m")), 0)
    agreement = (
        F.when(n <= 0, F.lit("machine_only")).when(n == 1, F.concat(F.lit("single:"), one["rater"]))
        .when(one["label"] == two["label"], "consensus").when(winner.isNotNull(), "disputed:majority").otherwise("disputed:unresolved")
    )
    rows = rows.withColumn("agreement", agreement)
    label = F.when(F.col("agreement").isin("machine_only", "disputed:unresolved"), F.col("m")).when(F.col("agreement") == "disputed:majority", winner["label"]).otherwise(one["label"])
    return rows.select("item_id", label.alias("label"), "agreement")


def stratified_sample(items: DataFrame, key: str, strata: list[str], size: int, seed: int = 0) -> DataFrame:
    """``size`` items, spread over the strata by largest remainders, in each by a hash of the key."""
    counts = items.groupBy(*strata).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    quota = counts.crossJoin(F.broadcast(total)).withColumn("exact", F.col("n") * F.lit(size) / F.col("total"))
    quota = quota.withColumn("base", F.floor("exact").cast("int"))
    order = Window.orderBy(F.desc(F.round(F.col("exact") - F.col("base"), 9)), *strata)
    spare = F.lit(size) - F.sum("base").over(Window.partitionBy())
    quota = quota.withColumn("take", F.col("base") + (F.row_number().over(order) <= spare).cast("int"))
    quota = quota.select(*[F.col(s).alias(f"_s{i}") for i, s in enumerate(strata)], "take")
    rows = items.withColumn("_lot", F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string"))))
    same = reduce(lambda a, b: a & b, [F.col(s).eqNullSafe(F.col(f"_s{i}")) for i, s in enumerate(strata)])
    # The first of each of many parts of a stratum, then the first of those: no task ranks a whole stratum.
    rows = rows.join(quota, same).withColumn("_part", F.pmod(F.xxhash64(key), F.lit(PARTS)))
    for within in ([*strata, "_part"], strata):
        rows = rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*within).orderBy("_lot", key))).where(F.col("_rank") <= F.col("take"))
    return rows.select(*items.columns)


def balanced_split(items: DataFrame, taken: DataFrame, key: str, strata: list[str], parts: int = 2, seed: int = 1, most: int = PIECE) -> DataFrame:
    """The items not ``taken`` with ``part``: dealt in turn, stratum after stratum.

    A running number needs no global sort of the items: in the order of their
    lots a stratum is cut by the first digits of the lot, and each piece starts
    where those before it end.  The lots are even, so a stratum has as many
    digits as leave about half of ``most`` items to a piece.
    """
    lot = F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")))
    rest = items.join(taken.select(key), key, "left_anti").withColumn("_lot", lot)
    digits = F.greatest(F.lit(0), F.ceil(F.log(16.0, F.col("_n") * 2.0 / most))).cast("int").alias("_digits")
    deep = rest.groupBy(*strata).agg(F.count(F.lit(1)).alias("_n")).select(*[F.col(s).alias(f"_t{i}") for i, s in enumerate(strata)], digits)
    here = reduce(lambda a, b: a & b, [F.col(s).eqNullSafe(F.col(f"_t{i}")) for i, s in enumerate(strata)])
    rest = rest.join(deep, here).withColumn("_piece", F.substr("_lot", F.lit(1), F.col("_digits"))).drop("_digits", *[f"_t{i}" for i in range(len(strata))])
    sizes = rest.groupBy(*strata, "_piece").agg(F.count(F.lit(1)).alias("_n"))
    starts = sizes.withColumn("_start", F.sum("_n").over(Window.orderBy(*strata, "_piece")) - F.col("_n"))
    starts = starts.select(*[F.col(s).alias(f"_s{i}") for i, s in enumerate(strata)], F.col("_piece").alias("_of"), "_start")
    rows = rest.withColumn("_at", F.row_number().over(Window.partitionBy(*strata, "_piece").orderBy("_lot", key)) - 1)
    same = reduce(lambda a, b: a & b, [F.col(s).eqNullSafe(F.col(f"_s{i}")) for i, s in enumerate(strata)]) & (F.col("_piece") == F.col("_of"))
    return rows.join(starts, same).select(*items.columns, ((F.col("_start") + F.col("_at")) % parts).alias("part"))


def upsert_forms(ids: DataFrame, forms: DataFrame, key: str) -> DataFrame:
    """One form for each id: the one there is, or a blank one."""
    return ids.select(key).distinct().join(forms, key, "left")


def truth_draw(steps: DataFrame, seed: int = 0) -> DataFrame:
    """run_id, actual: a step drawn for each run of three or more, for self-checks."""
    runs = steps.groupBy("run_id").agg(F.count(F.lit(1)).alias("n")).where("n >= 3")
    return runs.select("run_id", (draw(F.col("n") - 2, seed, F.col("run_id"), "origin") + 1).alias("actual"))
