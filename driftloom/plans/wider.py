"""Queries with anchors, omission, drift-only mode, whole sweeps, notes and data sets."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.vectors import entailment_label, softmax
from ..operators import attribute, calibrate, classify, drift, evaluate, inject, report, signals, verdict
from ..operators.steps import dealt, densified, skip_notes
from ..sources import arrays, datasets, folder, ingest, sinks
from .demo import PROFILE, SETTINGS, all_steps, r6, steps, table

#: Anchors are split into facts of 25 letters or more, and omission counts for flags and verdicts.
WIDE = replace(SETTINGS, profile=replace(PROFILE, coverage_threshold=0.2003, omission_threshold=0.2503, omission_collapse=0.9007), min_fact_chars=25)
SIGNALS = ("drift_prev", "drift_anchor", "entailment", "aggregate", "omission", "coverage")


def keys():
    return [F.col("run_id"), F.col("ordinal").cast("long").alias("ordinal")]


def first_texts(own: DataFrame) -> DataFrame:
    return own.where("ordinal = 0").select("run_id", F.lit("text").alias("kind"), F.array("text").alias("texts"))


def wide(spark, sf_dir):
    """Signals with each run's first text as its anchor."""
    own = steps(spark, sf_dir)
    return signals.signals(own, WIDE, first_texts(own), buckets=None)


def rounded(rows: DataFrame) -> DataFrame:
    return reduce(lambda df, c: df.withColumn(c, r6(c)), SIGNALS, rows)


def omission_signals(spark, sf_dir):
    return wide(spark, sf_dir).select(*keys(), *[r6(c).alias(c) for c in ("drift_anchor", "coverage", "omission", "aggregate")], F.array_join("flag_codes", ",").alias("codes"))


def flag_reasons(spark, sf_dir):
    """Reasons of the flags, of signals rounded to six places."""
    own = rounded(wide(spark, sf_dir)).withColumn("f", signals._flags(WIDE))
    return own.select(*keys(), F.array_join(F.transform("f", lambda f: f["reason"]), "; ").alias("reasons"), (F.size("f") > 0).alias("flagged"))


def verdict_reasons(spark, sf_dir):
    rows = verdict.verdicts(rounded(wide(spark, sf_dir)), WIDE.profile)
    return rows.select("run_id", "verdict", F.array_join("verdict_codes", ",").alias("codes"), F.array_join("verdict_reasons", "; ").alias("reasons"))


def _unjudged(spark, sf_dir):
    return signals.signals(steps(spark, sf_dir), SETTINGS, nli=False, buckets=None)


def drift_only_signals(spark, sf_dir):
    return _unjudged(spark, sf_dir).select(*keys(), r6("aggregate").alias("aggregate"), F.array_join("flag_codes", ",").alias("codes"))


def drift_only_scores(spark, sf_dir):
    return classify.rule_scores(_unjudged(spark, sf_dir), SETTINGS, nli=False).select("run_id", *[r6(k).alias(k) for k in classify.TYPES])


def drift_buckets(spark, sf_dir):
    rows = drift.bag_drift(steps(spark, sf_dir), buckets=128).where("ordinal > 0")
    return rows.select(*keys(), r6("drift_prev").alias("drift_prev"), r6("drift_anchor").alias("drift_anchor"))


def softmax_labels(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", softmax(F.transform(F.slice("embedding", 1, 3), lambda x: x.cast("double"))).alias("p"))
    e, n, c = (F.get("p", i) for i in range(3))
    return rows.select("vec_id", r6(e).alias("entailment"), r6(n).alias("neutral"), r6(c).alias("contradiction"), entailment_label(e, n, c).alias("label"))


def truncated_steps(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(T.truncated(F.col("text"))).select("doc_id")


def squeezed_texts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.squeezed(F.col("text"))).alias("squeezed_md5"))


def text_predicates(spark, sf_dir):
    name = F.concat(F.lit("run-"), (F.col("doc_id") % 13).cast("string"), F.lit("-"), F.col("source"))
    return table(spark, sf_dir, "documents").select("doc_id", T.batch_number(name).cast("long").alias("batch"), T.contains_any(F.col("text"), (" der ", " und ")).alias("second_language"))


def _gaps(spark, sf_dir):
    """Steps of which every third is blank, and of every tenth run all."""
    own = all_steps(spark, sf_dir)
    blank = (F.col("pos") % 3 == 1) | (F.col("run_id").cast("long") % 10 == 0)
    return own.withColumn("text", F.when(blank & (F.col("pos") % 2 == 0), F.lit(None)).when(blank, " \t\u00a0").otherwise(F.col("text")))


def skip_notes_query(spark, sf_dir):
    rows = skip_notes(_gaps(spark, sf_dir))
    return rows.select("run_id", "code", F.col("pos").cast("long").alias("pos"), "message")


def report_notes(spark, sf_dir):
    """Reports of runs with gaps: how many steps, which notes, whether degraded."""
    _, reports = report.analyze(_gaps(spark, sf_dir), SETTINGS, buckets=None)
    return reports.select("run_id", F.size("steps").cast("long").alias("n_steps"), F.array_join("notes", "; ").alias("notes"), "verdict", "degraded", F.col("monitoring_failure").isNull().alias("monitored"))


def report_reasons(spark, sf_dir):
    """Verdicts, types and origins as the nested reports have them."""
    _, reports = report.analyze(all_steps(spark, sf_dir), SETTINGS, buckets=None)
    origin = F.transform("attribution", lambda a: F.concat(a["origin_step"], F.lit(":"), F.format_string("%.3f", a["confidence"])))
    return reports.select(
        "run_id", "verdict", F.array_join(F.transform("classification", lambda c: c["cascade_type"]), ",").alias("types"), F.array_join(origin, ",").alias("origins"),
        F.size(F.filter("steps", lambda s: s["flagged"])).cast("long").alias("n_flagged"), F.round("thresholds.drift_threshold", 4).alias("drift_threshold"), F.col("models.nli").alias("nli"),
    )


def signal_ranking(spark, sf_dir):
    rows = evaluate.most_common(evaluate.signal_counts(wide(spark, sf_dir)), "signal")
    return rows.select("signal", "n", F.col("place").cast("long").alias("place"))


def holdout_calibrated(spark, sf_dir):
    """Levels of the first 15 runs applied to the others: how many fire by each variant."""
    own = signals.signals(steps(spark, sf_dir), SETTINGS, buckets=None)
    parts = calibrate.holdout(own.select("run_id").distinct().withColumn("number", F.col("run_id").cast("long")), "number", 15)
    rows = own.join(parts.select("run_id", "part"), "run_id")
    levels = calibrate.signal_percentiles(rows.where("part = 'calibrate'"))
    fired = calibrate.applied(rows.where("part = 'holdout'"), levels)
    return fired.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(v).alias(v) for v in ("prev", "anchor", "dual", "dual_nli")])


def _truth(own: DataFrame) -> DataFrame:
    """A made-up truth: two of three runs are true, with an origin by their number."""
    runs = own.groupBy("run_id").agg(F.count(F.lit(1)).alias("n"))
    number = F.col("run_id").cast("long")
    return runs.select("run_id", (number % 3 != 0).alias("truth"), (number % F.col("n")).cast("int").alias("origin"), "n")


def omission_before_after(spark, sf_dir):
    own = wide(spark, sf_dir)
    return evaluate.omission_effect(own, _truth(own))


def attribution_rescoring(spark, sf_dir):
    """First flags from stored scores against a machine's labels and labels resolved with two raters."""
    from .queries import _matrix

    runs = _matrix(spark, sf_dir)
    number, n = F.col("run_id").cast("long"), F.size("step_ids")
    machine = runs.select(F.col("run_id").alias("item_id"), (number % n).alias("label"), (number % 3 != 0).alias("truth"))
    rater = lambda name, label: runs.select(F.col("run_id").alias("item_id"), F.lit(name).alias("rater"), label.alias("label"))
    humans = rater("ann", (number * 3) % n).unionByName(rater("bob", F.when(number % 2 == 0, (number * 3) % n).otherwise(number % n)))
    resolved = evaluate.resolve_labels(humans, machine.select("item_id", "label")).join(machine.select("item_id", "truth"), "item_id")
    told = lambda rows, basis: rows.select(F.col("item_id").alias("run_id"), F.lit(basis).alias("basis"), "truth", F.col("label").cast("int").alias("origin"))
    rows = evaluate.rescored(runs, told(machine, "machine").unionByName(told(resolved, "resolved")), 0.2003, 0.2503)
    return rows.select("basis", "omission", "n", r6("exact").alias("exact"), r6("within1").alias("within1"))


#: name, aggregate, entailment, drift, omission, consecutive: three baselines, 26 single triggers, five disjunctions.
_SINGLES = {
    "aggregate": (0.4003, 0.5003, 0.5507, 0.6007, 0.6503, 0.7123), "entailment": (0.0511, 0.0601, 0.1001, 0.1503, 0.2003, 0.3003, 0.4007, 0.7207),
    "drift": (0.5003, 0.6007, 0.7013, 0.8011, 0.8507, 0.9013, 0.9513), "omission": (0.2003, 0.2503, 0.3401, 0.5007, 0.6703),
}
_PLACES = ("aggregate", "entailment", "drift", "omission")


def _rule(name: str, consecutive: bool | None = None, **levels: float) -> tuple:
    return (name, *[levels.get(p) for p in _PLACES[:3]], levels.get("omission"), consecutive)


RULES = [
    _rule("aggregate only", aggregate=0.6007), _rule("any flag", aggregate=0.6007, entailment=0.3003, drift=0.8011, omission=0.2503), _rule("two in a row", consecutive=True),
    *[_rule(f"{p} {x}", **{p: x}) for p, xs in _SINGLES.items() for x in xs],
    _rule("e a", entailment=0.0511, aggregate=0.7123), _rule("e+ a", entailment=0.1001, aggregate=0.7123), _rule("e d a", entailment=0.0511, drift=0.8507, aggregate=0.7123),
    _rule("e o a", entailment=0.0511, omission=0.3401, aggregate=0.7123), _rule("e d o a", entailment=0.0601, drift=0.9013, omission=0.5007, aggregate=0.7123),
]


def rule_sweep(spark, sf_dir):
    own = wide(spark, sf_dir)
    runs = own.groupBy("run_id").agg(F.max("aggregate").alias("max_aggregate"), F.min("entailment").alias("min_entailment"), F.max("drift_anchor").alias("max_drift"), F.max("omission").alias("max_omission"))
    runs = runs.join(evaluate.consecutive_flags(own), "run_id").withColumn("truth", F.col("run_id").cast("long") % 3 == 0)
    return evaluate.rule_sweep(runs, RULES)


def threshold_sweep_roles(spark, sf_dir):
    """The sweep with the omission flag off for one role."""
    from .queries import COVERS, OMITS, _matrix

    rows = evaluate.threshold_sweep(_matrix(spark, sf_dir), COVERS, OMITS, ("assistant",))
    return rows.select("cover", "omit", *[r6(c).alias(c) for c in ("exact", "within1", "fp_steps")], "fp_runs")


def detection_by_kind(spark, sf_dir):
    """All kinds of errors in all runs: how each variant detects them and how they are told."""
    own = all_steps(spark, sf_dir)
    changed, records = inject.inject_each(own)
    chars = own.agg(F.sum(F.length("text"))).first()[0] or 0
    found = signals.signals(densified(dealt(changed, chars * len(inject.KINDS))), SETTINGS, buckets=None, dealt=True)
    # All that is asked of a run comes from one aggregation, so its signals are made once.
    rows = attribute.candidate_columns(classify.rule_columns(found, SETTINGS), SETTINGS)
    runs = rows.groupBy("run_id").agg(
        *verdict.extremes(), *classify.rule_aggregates(), *evaluate.variants(PROFILE.drift_threshold, PROFILE.aggregate_threshold),
        F.coalesce(F.max_by("drift_anchor", "ordinal") > PROFILE.drift_threshold, F.lit(False)).alias("naive"), F.min(F.when(F.col("crossed") > 0, F.col("ordinal"))).alias("origin"),
    )
    scores = classify.scored(runs.withColumn("f", verdict.triggered(PROFILE)), SETTINGS)
    for k in classify.TYPES:
        scores = scores.withColumn(k, r6(k))
    told = F.size("f") > 0
    types = F.transform(classify.chosen(SETTINGS.class_cutoff, "any_flagged"), lambda c: c["cascade_type"])
    fired = scores.select("run_id", "prev", "anchor", "dual", "dual_nli", "naive", F.when(told, F.col("origin")).alias("predicted"), F.when(told & (F.col("n") > 0), types).alias("types"))
    rows = records.select("run_id", "kind", F.col("step_index").alias("actual")).join(fired, "run_id")
    shares = ("dual_nli", "dual", "prev", "anchor", "naive", "exact", "within1", "right_type")
    return evaluate.detection_table(rows).select("kind", "n", *[r6(c).alias(c) for c in shares])


def _domains(spark, sf_dir):
    own = all_steps(spark, sf_dir)
    return own.groupBy("run_id").agg(F.min_by("role", "pos").alias("domain"))


def _told(c: str = "steps"):
    return F.md5(F.array_join(F.transform(c, lambda s: F.concat(s["step_id"], F.lit("|"), s["text"])), "\n"))


def dataset_clean(spark, sf_dir):
    rows = datasets.clean_split(all_steps(spark, sf_dir), _domains(spark, sf_dir))
    return rows.select("id", "domain", F.col("n_steps").cast("long").alias("n_steps"), _told().alias("steps_md5"))


def dataset_injected(spark, sf_dir):
    rows = datasets.injected_split(all_steps(spark, sf_dir), _domains(spark, sf_dir), lambda run: run.cast("long") * 7 + 1)
    return rows.select("id", "source_id", "domain", "injection_kind", "origin_step_id", F.col("origin_step_index").cast("long").alias("origin_step_index"), "original_text", "injected_text", _told().alias("steps_md5"), "seed")


def dataset_labelled(spark, sf_dir):
    own = all_steps(spark, sf_dir)
    number = F.col("run_id").cast("long")
    chains = own.groupBy("run_id").agg(F.min_by("text", "pos").alias("question"), F.max_by("text", "pos").alias("source")).withColumn("model", F.lit("m")).withColumn("temperature", F.lit(0.7))
    truth = _truth(densified(own))
    passes = truth.select("run_id", F.lit("ann").alias("rater"), F.col("truth").alias("cascade_occurred"), F.col("origin").alias("origin_step"), F.lit("omission").alias("error_type"))
    passes = passes.unionByName(passes.where(number % 2 == 0).withColumn("rater", F.lit("bob")).withColumn("origin_step", (F.col("origin_step") + (number % 4 == 0).cast("int"))))
    labels = passes.where("rater = 'ann'").where(number % 5 != 4).select("run_id", "cascade_occurred", "origin_step", "error_type", F.lit("said so").alias("evidence"), F.lit(None).cast("string").alias("notes"), F.lit("consensus").alias("label_agreement"))
    rows = datasets.labelled_split(own, chains, labels, passes)
    by = F.array_join(F.transform("annotator_labels", lambda p: F.concat(p["rater"], F.lit(":"), p["origin_step"].cast("string"))), ",")
    return rows.select("id", F.md5("question").alias("question_md5"), F.md5("source").alias("source_md5"), "model", "temperature", F.size("steps").cast("long").alias("n_steps"), "cascade_occurred", F.col("origin_step").cast("long").alias("origin_step"), "evidence", "annotation_notes", "label_agreement", by.alias("annotator_labels"))


def _payloads(spark, sf_dir):
    """Turns as JSON payloads: whole ones, some that lack a key or have one too many, some that are no object."""
    own = table(spark, sf_dir, "conversations")
    named = lambda **parts: F.to_json(F.struct(*[c.alias(k) for k, c in parts.items()]))
    turn, said, role = F.col("turn"), F.col("text"), F.col("role")
    kinds = [
        named(step_id=turn, text=said, role=role), named(text=said, role=role, tool=F.lit("x"), metadata=F.struct(F.lit(1).alias("a"))), named(step_id=F.concat(F.lit("s"), turn.cast("string")), text=F.lit(5)),
        F.lit('"garbage"'), named(step_id=turn), named(step_id=turn, text=said, metadata=F.lit(7), modality=F.lit("audio")),
    ]
    payload = F.element_at(F.array(*kinds), (turn % len(kinds) + 1).cast("int"))
    return own.select(F.col("conv_id").cast("string").alias("run_id"), turn.cast("int").alias("idx"), payload.alias("payload"))


def ingested_steps(spark, sf_dir):
    rows, _ = ingest.from_payloads(_payloads(spark, sf_dir))
    extras = F.array_join(F.array_sort(F.map_keys("metadata")), ",")
    return rows.select("run_id", F.col("pos").cast("long").alias("pos"), "step_id", "role", "modality", extras.alias("metadata_keys"), "text")


def ingest_notes(spark, sf_dir):
    _, notes = ingest.from_payloads(_payloads(spark, sf_dir))
    return notes.select("run_id", F.col("pos").cast("long").alias("pos"), "code", "message")


def payload_files(spark, sf_dir):
    """Runs as the contents of files, JSON lines for even numbers and arrays for odd ones, and the steps read from them."""
    own = table(spark, sf_dir, "conversations")
    one = F.struct("turn", F.to_json(F.struct(F.col("turn").alias("step_id"), "text", "role")).alias("j"))
    files = own.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["j"]).alias("j"))
    lines, array = F.array_join("j", "\r\n"), F.concat(F.lit("["), F.array_join("j", ", "), F.lit("]"))
    even = F.col("conv_id") % 2 == 0
    files = files.select(F.concat(F.col("conv_id").cast("string"), F.when(even, ".jsonl").otherwise(".json")).alias("run_id"), F.when(even, lines).otherwise(array).alias("value"))
    rows, _ = ingest.from_payloads(ingest.payloads_of(files))
    return rows.select("run_id", F.col("pos").cast("long").alias("pos"), "step_id", "role", "text")


def array_ranges(spark, sf_dir):
    """Runs as arrays whose text comes in pieces between commas, seven to a block, and the steps found in them."""
    own = table(spark, sf_dir, "conversations")
    one = F.struct("turn", F.to_json(F.struct(F.col("turn").alias("step_id"), "text", "role")).alias("j"))
    files = own.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["j"]).alias("j"))
    text = F.concat(F.lit("["), F.array_join("j", ", "), F.lit("]"))
    pieces = files.select(F.col("conv_id").cast("string").alias("run_id"), F.posexplode(F.split(text, ",", -1)).alias("place", "value"))
    rows, _ = ingest.from_payloads(arrays.elements(pieces.withColumn("block", F.floor(F.col("place") / 7))))
    return rows.select("run_id", F.col("pos").cast("long").alias("pos"), "step_id", "role", "text")


def files_put_aside(spark, sf_dir):
    """Runs as the contents of files, arrays that are cut off where the last turn is a user's: what is read, and what is put aside."""
    own = table(spark, sf_dir, "conversations")
    one = F.struct("turn", F.to_json(F.struct(F.col("turn").alias("step_id"), "text", "role")).alias("j"))
    files = own.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["j"]).alias("j"), F.max_by("role", "turn").alias("last"))
    text = F.concat(F.lit("["), F.array_join("j", ","), F.when(F.col("last") == "user", "").otherwise("]"))
    good, aside = folder.sorted_out(files.select(F.concat(F.col("conv_id").cast("string"), F.lit(".json")).alias("run_id"), text.alias("value")))
    rows, notes = ingest.from_payloads(ingest.payloads_of(good))
    counts = rows.groupBy("run_id").agg(F.count(F.lit(1)).alias("n_steps"))
    told = notes.unionByName(aside).groupBy("run_id").agg(F.max("message").alias("message"))
    return counts.join(told, "run_id", "full").select("run_id", F.coalesce("n_steps", F.lit(0)).alias("n_steps"), F.coalesce("message", F.lit("")).alias("message"))


def report_documents(spark, sf_dir):
    """Reports as JSON, read back."""
    _, reports = report.analyze(all_steps(spark, sf_dir), SETTINGS, buckets=None)
    told = lambda path: F.get_json_object("report", path)
    rows = sinks.as_json(reports)
    return rows.select("run_id", (told("$.verdict") == "true").alias("verdict"), F.json_array_length(told("$.steps")).cast("long").alias("n_steps"), told("$.models.nli").alias("nli"), told("$.steps[0].step_id").alias("first_step"))


QUERIES = {
    f.__name__.removesuffix("_query"): f
    for f in (
        omission_signals, flag_reasons, verdict_reasons, drift_only_signals, drift_only_scores, drift_buckets, softmax_labels, truncated_steps, squeezed_texts, text_predicates,
        skip_notes_query, report_notes, report_reasons, signal_ranking, holdout_calibrated, omission_before_after, attribution_rescoring, rule_sweep, threshold_sweep_roles,
        ingested_steps, ingest_notes, payload_files, array_ranges, files_put_aside, report_documents, detection_by_kind, dataset_clean, dataset_injected, dataset_labelled,
    )
}
