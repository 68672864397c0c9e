"""One query for each family of operators, over whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import attribute, calibrate, classify, drift, evaluate, inject, report, signals, stretches, verdict
from ..operators.steps import as_steps
from ..sources.shared import shared_dir
from ..streaming.observer import logged, replay
from . import scoring, wider
from .demo import LEXICON, PROFILE, SETTINGS, all_steps, r6, steps, table, vectors

TRUTH = 3


def _keys() -> list[Column]:
    return [F.col("run_id"), F.col("ordinal").cast("long").alias("ordinal")]


def _signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.signals(steps(spark, sf_dir), SETTINGS, buckets=None)


def _anchors(own: DataFrame) -> DataFrame:
    """Each run's first text as its anchor."""
    return own.where("ordinal = 0").select("run_id", F.lit("text").alias("kind"), F.array("text").alias("texts"))


def measurable_steps(spark, sf_dir):
    return steps(spark, sf_dir).select("run_id", "ordinal", "pos", "step_id", "role")


def drift_prev_bow(spark, sf_dir):
    return drift.bag_drift(steps(spark, sf_dir)).where("ordinal > 0").select(*_keys(), r6("drift_prev").alias("drift_prev"))


def drift_anchor_bow(spark, sf_dir):
    return drift.bag_drift(steps(spark, sf_dir)).select(*_keys(), r6("drift_anchor").alias("drift_anchor"), r6("combined_drift").alias("combined_drift"))


def drift_given_anchor(spark, sf_dir):
    own = steps(spark, sf_dir)
    last = own.groupBy("run_id").agg(F.max_by("text", "ordinal").alias("b"), F.min_by("text", "ordinal").alias("a")).select("run_id", F.array("a", "b").alias("texts"))
    return drift.bag_drift(own, last).select(*_keys(), r6("drift_prev").alias("drift_prev"), r6("drift_anchor").alias("drift_anchor"))


def drift_dual_dense(spark, sf_dir):
    rows = drift.dense_drift(vectors(spark, sf_dir), "embedding")
    return rows.select(*_keys(), r6("drift_prev").alias("drift_prev"), r6("drift_anchor").alias("drift_anchor"))


def drift_consensus_anchor(spark, sf_dir):
    own = vectors(spark, sf_dir)
    rows = drift.dense_drift(own, "embedding", drift.consensus(own, "run_id", "embedding"))
    return rows.select(*_keys(), r6("drift_anchor").alias("drift_anchor"))


def max_drift_step(spark, sf_dir):
    rows = drift.bag_drift(steps(spark, sf_dir)).withColumn("combined_drift", r6("combined_drift"))
    return drift.most_drifted(rows).select(*_keys(), "combined_drift")


def drift_flags(spark, sf_dir):
    rows = drift.bag_drift(steps(spark, sf_dir)).withColumn("codes", drift.drift_codes(PROFILE.drift_threshold))
    return drift.flagged_steps(rows.withColumn("flagged", F.size("codes") > 0)).select(*_keys(), F.array_join("codes", ",").alias("codes"))


def entailment_overlap(spark, sf_dir):
    rows = signals.entailment(steps(spark, sf_dir)).where("ordinal > 0")
    return rows.select(*_keys(), *[r6(c).alias(c) for c in ("entailment", "neutral", "contradiction")])


def certainty_signal(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", T.certainty(F.col("text"), LEXICON).alias("c")).select("doc_id", "c.*")
    return rows.select("doc_id", r6("score").alias("score"), F.col("hedge_hits").cast("long").alias("hedge_hits"), F.col("certainty_hits").cast("long").alias("certainty_hits"), "conclusive")


def certainty_delta(spark, sf_dir):
    return signals.certainties(steps(spark, sf_dir), SETTINGS).select(*_keys(), r6("score").alias("score"), r6("certainty_delta").alias("certainty_delta"))


def facts_split(spark, sf_dir):
    found = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.facts(F.col("text"), 1 << 30, 0)).alias("fact_idx", "fact"))
    return found.select("doc_id", "fact_idx", "fact")


def coverage_omission(spark, sf_dir):
    own = steps(spark, sf_dir)
    facts = signals.anchor_facts(_anchors(own), replace(SETTINGS, min_fact_chars=0))
    rows = signals.coverage(own, facts, 0.2003)
    return rows.select(*_keys(), r6("coverage").alias("coverage"), r6("omission").alias("omission"))


def aggregate_score(spark, sf_dir):
    return _signals(spark, sf_dir).select(*_keys(), r6("aggregate").alias("aggregate"), "flagged", F.array_join("flag_codes", ",").alias("codes"))


def verdicts(spark, sf_dir):
    rows = verdict.verdicts(_signals(spark, sf_dir), PROFILE)
    return rows.select("run_id", "verdict", F.array_join("verdict_codes", ",").alias("codes"))


def verdict_extremes(spark, sf_dir):
    rounded = _signals(spark, sf_dir)
    for c in ("aggregate", "entailment", "omission", "drift_anchor"):
        rounded = rounded.withColumn(c, r6(c))
    rows = rounded.groupBy("run_id").agg(*verdict.extremes())
    return rows.select("run_id", *[F.col(f"x_{c}")[f].alias(f"{c}_{n}") for c in ("aggregate", "entailment", "drift_anchor") for f, n in (("value", "value"), ("step_num", "step"))])


def classify_scores(spark, sf_dir):
    rows = classify.rule_scores(_signals(spark, sf_dir), SETTINGS)
    return rows.select("run_id", *[r6(k).alias(k) for k in classify.TYPES])


def classification(spark, sf_dir):
    scores = classify.rule_scores(_signals(spark, sf_dir), SETTINGS)
    for k in classify.TYPES:
        scores = scores.withColumn(k, r6(k))
    rows = classify.classification(scores, SETTINGS.class_cutoff)
    return rows.select("run_id", F.array_join(F.transform("classification", lambda c: c["cascade_type"]), ",").alias("types"))


def attribution(spark, sf_dir):
    rows = attribute.candidates(_signals(spark, sf_dir), SETTINGS)
    return rows.select(*_keys(), "step_id", F.col("crossed").cast("long").alias("crossed"), "confidence")


def report_summary(spark, sf_dir):
    _, reports = report.analyze(all_steps(spark, sf_dir), SETTINGS, buckets=None)
    return reports.select("run_id", "verdict", F.size("steps").cast("long").alias("n_steps"), F.size("classification").cast("long").alias("n_types"), F.size("attribution").cast("long").alias("n_origins"), F.get("attribution", 0)["origin_step"].alias("first_origin"), "degraded")


def calibrate_percentile(spark, sf_dir):
    return calibrate.calibration(drift.bag_drift(steps(spark, sf_dir)), 95.0)


def signal_percentiles(spark, sf_dir):
    rows = calibrate.signal_percentiles(_signals(spark, sf_dir))
    return rows.select(*[r6(c).alias(c) for c in rows.columns])


def holdout_rates(spark, sf_dir):
    fired = _signals(spark, sf_dir).groupBy("run_id").agg(F.bool_or("flagged").alias("fired"))
    parts = calibrate.holdout(fired.withColumn("number", F.col("run_id").cast("long")), "number", 15)
    return parts.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.count_if("fired").alias("n_fired"))


def ablation_variants(spark, sf_dir):
    return evaluate.ablation(_signals(spark, sf_dir), PROFILE.drift_threshold, PROFILE.aggregate_threshold)


def naive_baseline(spark, sf_dir):
    rows = evaluate.naive_baseline(drift.bag_drift(steps(spark, sf_dir)), PROFILE.drift_threshold)
    return rows.select("run_id", r6("distance").alias("distance"), "naive")


def consecutive_flags(spark, sf_dir):
    return evaluate.consecutive_flags(_signals(spark, sf_dir))


def signal_counts(spark, sf_dir):
    return evaluate.signal_counts(_signals(spark, sf_dir))


COVERS, OMITS = [0.0701, 0.1001, 0.1503, 0.2003, 0.2507, 0.3003, 0.4007], [0.0503, 0.1501, 0.2003, 0.2503, 0.3401, 0.5007, 0.6703]


def _matrix(spark, sf_dir):
    """Stored scores: each step's entailment of the facts of its run's first text."""
    from ..operators.scorers import overlap

    own = steps(spark, sf_dir)
    facts = own.where("ordinal = 0").select("run_id", F.transform(T.facts(F.col("text"), 12, 0), lambda f: T.word_set(f)).alias("facts"))
    flagged = _signals(spark, sf_dir).select("run_id", "ordinal", "flagged")
    rows = own.join(facts, "run_id").join(flagged, ["run_id", "ordinal"])
    rows = rows.withColumn("w", T.word_set(F.col("text")))
    cell = F.transform("facts", lambda f: overlap(F.col("w"), f)["entailment"])
    one = F.struct("ordinal", "role", "flagged", cell.alias("row"))
    runs = rows.groupBy("run_id").agg(F.array_sort(F.collect_list(one)).alias("s"))
    part = lambda k: F.transform("s", lambda x: x[k])
    runs = runs.select("run_id", part("ordinal").alias("step_ids"), part("role").alias("roles"), part("flagged").alias("flagged"), part("row").alias("matrix"))
    n = F.size("step_ids")
    return runs.withColumn("truth", F.col("run_id").cast("long") % TRUTH != 0).withColumn("origin", (F.col("run_id").cast("long") % n).cast("int"))


def threshold_sweep(spark, sf_dir):
    rows = evaluate.threshold_sweep(_matrix(spark, sf_dir), COVERS, OMITS)
    return rows.select("cover", "omit", *[r6(c).alias(c) for c in ("exact", "within1", "fp_steps")], "fp_runs")


def best_setting(spark, sf_dir):
    rows = threshold_sweep(spark, sf_dir)
    return evaluate.best_setting(rows)


def first_flag_accuracy(spark, sf_dir):
    own = steps(spark, sf_dir)
    pairs = evaluate.truth_draw(own).join(evaluate.first_flagged(_signals(spark, sf_dir)), "run_id")
    rows = evaluate.accuracy(pairs)
    return rows.select("n", r6("exact").alias("exact"), r6("within1").alias("within1"))


def kappa_quality_toxic(spark, sf_dir):
    rows = evaluate.kappa(table(spark, sf_dir, "labels"), "quality", "toxic")
    return rows.select("n", *[r6(c).alias(c) for c in ("observed", "expected", "kappa")])


def label_distribution(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), "doc_id")
    found = evaluate.distribution(rows, "quality", "lang", "source")
    return found.select("quality", "lang", "source", "n", r6("share").alias("share"))


def _passes(spark, sf_dir):
    own = table(spark, sf_dir, "labels")
    humans = own.select(F.col("doc_id").alias("item_id"), F.lit("ann").alias("rater"), "quality")
    humans = humans.unionByName(own.select(F.col("doc_id").alias("item_id"), F.lit("bob").alias("rater"), F.col("toxic").alias("quality")))
    machine = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), (F.col("doc_id") % 2).alias("label"))
    return humans.select("item_id", "rater", F.col("quality").cast("long").alias("label")), machine


def label_resolution(spark, sf_dir):
    return evaluate.resolve_labels(*_passes(spark, sf_dir))


def rater_agreement(spark, sf_dir):
    humans, _ = _passes(spark, sf_dir)
    pairs = evaluate.rater_pairs(humans, table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id")))
    return pairs.groupBy("rater_a", "rater_b").agg(F.count(F.lit(1)).alias("n"), F.count_if(evaluate.within_one(F.col("label_a"), F.col("label_b"))).alias("near"), F.count_if(F.col("label_a") == F.col("label_b")).alias("same"))


def stratified_sample(spark, sf_dir):
    return evaluate.stratified_sample(table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), "doc_id", ["lang", "source"], 40)


def balanced_split(spark, sf_dir):
    own = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    taken = evaluate.stratified_sample(own, "doc_id", ["lang", "source"], 40)
    return evaluate.balanced_split(own, taken, "doc_id", ["lang", "source"])


def form_upsert(spark, sf_dir):
    ids = table(spark, sf_dir, "documents").select("doc_id")
    return evaluate.upsert_forms(ids, table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id").select("doc_id", "quality")


def _injected(kind, spark, sf_dir):
    _, records = inject.inject(all_steps(spark, sf_dir), kind)
    return records.select("run_id", F.col("step_index").cast("long").alias("step_index"), "kind", "original_text", "injected_text")


def inject_numeric(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", inject.injected(F.col("text"), "numeric_fabrication", 0, F.col("doc_id")).alias("injected"))
    return rows.select("doc_id", F.md5("injected").alias("injected_md5"))


def index_quantiles(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("label", F.get("embedding", 0).cast("double").alias("x"))
    return evaluate.index_quantiles(rows, "x", "label").select(F.col("label").cast("long").alias("label"), *[r6(c).alias(c) for c in ("low", "p25", "middle", "high")])


def stream_drift_replay(spark, sf_dir):
    kind = "conv_id long, turn long, role string, text string"
    events = as_steps(spark.readStream.schema(kind).parquet(f"{sf_dir}/conversations.parquet*"), "conv_id", "turn", role="role")
    rows = replay(spark, events.select("run_id", F.col("pos").alias("idx"), "pos", "step_id", "text"), PROFILE.drift_threshold)
    return rows.select(*_keys(), "step_id", r6("drift_prev").alias("drift_prev"), r6("drift_anchor").alias("drift_anchor"), "flagged", "fresh", F.coalesce("note", F.lit("")).alias("note"))


def push_log_replay(spark, sf_dir):
    """Steps that arrive out of order, some without text, through the segments of a log: every row of the stream, with its note."""
    rows = table(spark, sf_dir, "conversations")
    arrival = (F.col("conv_id") * 7 + F.col("turn") * 5) % 3 * 3 + F.col("turn")
    text = F.when(F.col("role") != "system", F.col("text")).otherwise(F.lit(" "))
    run = F.col("conv_id").cast("string")
    step = F.concat(F.lit("s"), F.floor(F.col("turn") / 2).cast("string"))  # two turns share an id: the second flag of one is not fresh
    seen = rows.select(run.alias("run_id"), (arrival * 100 + F.col("turn")).alias("idx"), F.to_json(F.struct(text.alias("text"))).alias("payload"), F.col("turn").cast("int").alias("pos"), step.alias("step_id"), text.alias("text"))
    path = f"{shared_dir(spark)}/log-{uuid.uuid4().hex}"
    seen.write.json(path)
    found = replay(spark, logged(spark, path), PROFILE.drift_threshold)
    return found.select("run_id", "idx", F.col("pos").cast("long").alias("pos"), "step_id", F.col("ordinal").cast("long").alias("ordinal"), r6("drift_prev").alias("drift_prev"), r6("drift_anchor").alias("drift_anchor"), "flagged", "fresh", F.coalesce("note", F.lit("")).alias("note"))


def _one_run(spark, sf_dir):
    """All conversations as the steps of one long run, cut into stretches of 100."""
    rows = table(spark, sf_dir, "conversations")
    own = rows.select(F.lit("all").alias("run_id"), (F.col("conv_id") * 100 + F.col("turn")).cast("int").alias("pos"), F.concat_ws(".", "conv_id", "turn").alias("step_id"), F.col("role").alias("agent_name"), "role", "text")
    return stretches.long_signals(stretches.numbered(own), SETTINGS, buckets=None, size=100)


def long_run_signals(spark, sf_dir):
    numbers = [r6(c).alias(c) for c in ("drift_prev", "drift_anchor", "entailment", "certainty_delta", "aggregate")]
    return _one_run(spark, sf_dir).select(*_keys(), "step_id", *numbers, "flagged", F.array_join("flag_codes", ",").alias("codes"))


def long_run_scores(spark, sf_dir):
    own = stretches.written(_one_run(spark, sf_dir), "signals")
    scores = stretches.long_rule_scores(own, SETTINGS, size=100).select("run_id", *[r6(c).alias(c) for c in ("retrieval", "inference", "context_poisoning", "confidence_inflation")])
    origins = stretches.long_candidates(own, SETTINGS).groupBy("run_id").agg(F.count(F.lit(1)).alias("n_origins"), F.min_by("step_id", "ordinal").alias("first_origin"), F.max("confidence").alias("top_confidence"))
    told = verdict.verdicts(own, PROFILE).select("run_id", F.array_join("verdict_codes", ",").alias("codes"))
    return scores.join(origins, "run_id").join(told, "run_id").join(stretches.long_consecutive(own, 100), "run_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        measurable_steps, drift_prev_bow, drift_anchor_bow, drift_given_anchor, drift_dual_dense, drift_consensus_anchor, max_drift_step, drift_flags,
        entailment_overlap, certainty_signal, certainty_delta, facts_split, coverage_omission, aggregate_score, verdicts, verdict_extremes,
        classify_scores, classification, attribution, report_summary, calibrate_percentile, signal_percentiles, holdout_rates, ablation_variants, naive_baseline,
        consecutive_flags, signal_counts, threshold_sweep, best_setting, first_flag_accuracy, kappa_quality_toxic, label_distribution,
        label_resolution, rater_agreement, stratified_sample, balanced_split, form_upsert, inject_numeric, index_quantiles, stream_drift_replay, push_log_replay, long_run_signals, long_run_scores,
    )
}
QUERIES |= wider.QUERIES
QUERIES |= scoring.QUERIES
QUERIES |= {f"inject_{k.split('_', 1)[0] if k != 'context_swap' else 'swap'}_step": partial(_injected, k) for k in ("causal_leap", "context_swap", "certainty_inflation", "entity_distortion")}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps by how far they drifted."""
    return drift.bag_drift(steps(spark, sf_dir)).withColumn("rank", F.row_number().over(Window.partitionBy("run_id").orderBy(F.desc("combined_drift"), "ordinal")))
