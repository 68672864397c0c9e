"""Calibration, injection and evaluation against plain versions."""

import random
import re
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftloom.config import Profile
from driftloom.operators import calibrate, drift, evaluate, inject, places
from driftloom.operators.steps import densified
from driftloom.sources import datasets
from tests.operators.test_signals import steps


def test_profile_round_trip(tmp_path):
    path = f"{tmp_path}/p.json"
    Profile(name="x", drift_threshold=0.4, entail_collapse=None).save(path)
    assert Profile.load(path) == Profile(name="x", drift_threshold=0.4, entail_collapse=None)
    (tmp_path / "old.json").write_text('{"name": "old", "drift_threshold": 0.8, "unknown": 1}')
    assert Profile.load(f"{tmp_path}/old.json") == Profile(name="old", drift_threshold=0.8)


def test_calibration_equals_numpy(spark):
    own = steps(spark, ["a b", "a c", "d e", "a b c d"]).unionByName(steps(spark, ["q", "q w"], run="s")).unionByName(steps(spark, [""], run="t"))
    rows = drift.bag_drift(densified(own))
    values = [v for r in rows.collect() for v in (r.drift_prev, r.drift_anchor) if v is not None]
    got = calibrate.calibrate(own, rows, 90.0, "p90")
    assert got.n_runs == 3 and got.n_measurements == len(values) == 8
    assert got.profile.drift_threshold == pytest.approx(np.percentile(values, 90), abs=1e-4) and got.drift_std == pytest.approx(np.std(values), abs=1e-4)
    with pytest.raises(ValueError):
        calibrate.calibrate(own, rows.where("run_id = 't'"))


@pytest.mark.parametrize("kind", inject.KINDS)
@pytest.mark.parametrize("rng", ["hash", "python"])
def test_injection_changes_one_later_step(spark, kind, rng):
    texts = ["It rose by 1,097 in Paris.", "Sales in Lima might be 12.5 percent.", "They may grow in Oslo by 7.", "The end of Rome is not 3."]
    own = steps(spark, texts).unionByName(steps(spark, ["a", "b"], run="short"))
    one, records = inject.inject(own, kind, seed=5, rng=rng)
    changed = [(r.pos, r.text) for r in one.where("run_id = 'r'").orderBy("pos").collect() if r.text != texts[r.pos]]
    record = records.collect()
    assert len(record) == 1 and changed == [(record[0].step_index, record[0].injected_text)] and 1 <= changed[0][0] <= 2
    assert record[0].original_text == texts[changed[0][0]] and record[0].kind == kind
    again = inject.inject(own, kind, seed=5, rng=rng)[1].first()
    assert again.injected_text == record[0].injected_text
    assert inject.inject(own, kind, index=3, rng=rng)[1].first().step_index == 3


def test_python_draws_are_those_of_the_seed(spark):
    texts = ["zero 0", "one 11", "two 22", "three 33"]
    record = inject.inject(steps(spark, texts), "numeric_fabrication", seed=9, rng="python")[1].first()
    rng = random.Random(9)
    at = rng.randrange(1, 3)
    n = int(re.search(r"\d+", texts[at])[0])
    assert (record.step_index, record.injected_text) == (at, texts[at].replace(str(n), str(n * rng.randrange(3, 9) + rng.randrange(7, 97))))


def test_injection_texts(spark):
    def told(text, kind):
        return spark.range(1).select(inject.injected(F.lit(text), kind, 0, F.lit("k")).alias("x")).first()["x"]

    assert told("It Might rain and MAY snow", "certainty_inflation") == "It definitely rain and certainly snow"
    assert told("No hedge", "certainty_inflation") == inject.ASSURANCE + "no hedge" and told("", "certainty_inflation") == inject.ASSURANCE
    assert re.fullmatch(r"none The measured figure is exactly \d{4} units\.", told("none", "numeric_fabrication"))
    assert re.fullmatch(r"about \d+ of 5", told("about 1,097 of 5", "numeric_fabrication"))
    assert told("He said Jakarta then. Lima", "entity_distortion").startswith("He said ") and "Jakarta" not in told("He said Jakarta then", "entity_distortion")
    assert "originally reported" in told("nothing here", "entity_distortion")
    with pytest.raises(ValueError):
        told("x", "nonsense")


def test_kappa_against_the_formula(spark):
    rng = random.Random(1)
    rows = [(rng.choice("xyz"), rng.choice("xyz")) for _ in range(60)] + [("x", "x")] * 30 + [(None, "x")]
    got = evaluate.kappa(spark.createDataFrame(rows, "a string, b string"), "a", "b").first()
    pairs = [r for r in rows if r[0]]
    po = sum(a == b for a, b in pairs) / len(pairs)
    pe = sum(sum(a == k for a, _ in pairs) * sum(b == k for _, b in pairs) for k in "xyz") / len(pairs) ** 2
    assert got.kappa == pytest.approx((po - pe) / (1 - pe))
    assert evaluate.kappa(spark.createDataFrame([("x", "x")] * 3, "a string, b string"), "a", "b").first().kappa is None
    assert evaluate.kappa(spark.createDataFrame([("x", "y")], "a string, b string"), "a", "b").first().kappa is None


def test_accuracy_counts_no_prediction_as_a_miss(spark):
    rows = [(1, 1), (2, 1), (None, 1), (5, 1)]
    got = evaluate.accuracy(spark.createDataFrame(rows, "predicted int, actual int")).first()
    assert (got.n, got.exact, got.within1) == (4, 0.25, 0.5)
    near = spark.createDataFrame([(1, 2), (None, None), (None, 1), (1, 3)], "a int, b int").select(evaluate.within_one(F.col("a"), F.col("b")).alias("x"))
    assert [r.x for r in near.collect()] == [True, True, False, False]


def test_threshold_sweep_on_stored_scores(spark):
    kind = "run_id string, truth boolean, origin int, step_ids array<int>, roles array<string>, flagged array<boolean>, matrix array<array<double>>"
    rows = [
        ("a", True, 2, [1, 2, 3], ["x", "x", "writer"], [False, False, False], [[0.9, 0.9], [0.9, 0.1], [0.1, 0.1]]),
        ("b", False, None, [1, 2], ["x", "writer"], [False, False], [[0.9, 0.9], [0.1, 0.9]]),
        ("c", True, 1, [1, 2], ["x", "x"], [False, True], [[0.9, 0.9], [0.9, 0.9]]),
        ("d", True, 1, [1], ["x"], [True], []),
    ]
    runs = spark.createDataFrame(rows, kind)
    got = {(r.cover, r.omit): r for r in evaluate.threshold_sweep(runs, [0.5], [0.25, 0.75]).collect()}
    assert (got[0.5, 0.25].exact, got[0.5, 0.25].within1, got[0.5, 0.25].fp_steps, got[0.5, 0.25].fp_runs) == (0.5, 1.0, 0.5, 1)
    assert (got[0.5, 0.75].exact, got[0.5, 0.75].within1, got[0.5, 0.75].fp_steps) == (0.0, 0.5, 0.0)
    assert evaluate.best_setting(evaluate.threshold_sweep(runs, [0.5], [0.25, 0.75])).first().omit == 0.25
    assert evaluate.threshold_sweep(runs, [0.5], [0.25], ("writer",)).first().fp_steps == 0.0


def test_labels_are_resolved_by_fixed_rules(spark):
    humans = [("1", "ann", "x"), ("2", "ann", "x"), ("2", "bob", "x"), ("3", "ann", "x"), ("3", "bob", "y"), ("4", "ann", "x"), ("4", "bob", "y"), ("5", "bob", None)]
    machine = [("0", "m"), ("1", "m"), ("2", "m"), ("3", "y"), ("4", "z"), ("5", "m")]
    got = {r.item_id: (r.label, r.agreement) for r in evaluate.resolve_labels(spark.createDataFrame(humans, "item_id string, rater string, label string"), spark.createDataFrame(machine, "item_id string, label string")).collect()}
    assert got == {"0": ("m", "machine_only"), "1": ("x", "single:ann"), "2": ("x", "consensus"), "3": ("y", "disputed:majority"), "4": ("z", "disputed:unresolved"), "5": ("m", "machine_only")}


def test_samples_and_splits(spark):
    rows = [(i, "ab"[i % 3 == 0], "xyz"[i % 3]) for i in range(50)]
    items = spark.createDataFrame(rows, "id int, p string, q string")
    taken = evaluate.stratified_sample(items, "id", ["p", "q"], 11)
    assert taken.count() == 11
    split = evaluate.balanced_split(items, taken, "id", ["p", "q"])
    parts = [r.part for r in split.collect()]
    assert len(parts) == 39 and abs(parts.count(0) - parts.count(1)) <= 1
    forms = evaluate.upsert_forms(items, spark.createDataFrame([(3, "done")], "id int, note string"), "id").collect()
    assert len(forms) == 50 and sum(r.note is not None for r in forms) == 1


def test_index_quantiles_and_counts(spark):
    values = [5.0, 1.0, 9.0, 7.0, 3.0, 8.0]
    got = evaluate.index_quantiles(spark.createDataFrame([("g", v) for v in values] + [("g", None)], "k string, v double"), "v", "k").first()
    s = sorted(values)
    assert (got.low, got.p25, got.middle, got.high) == (s[0], s[len(s) // 4], s[len(s) // 2], s[-1]) and statistics.median(s) != got.middle
    flags = spark.createDataFrame([("r", 0, True, ["drift_prev 1", "drift_anchor 2", "omission 1"]), ("r", 1, True, ["drift_prev 1"]), ("r", 2, False, [])], "run_id string, ordinal int, flagged boolean, flag_reasons array<string>")
    assert {r.signal: r.n for r in evaluate.signal_counts(flags).collect()} == {"drift": 2, "omission": 1}
    assert evaluate.consecutive_flags(flags).first().consecutive


def test_places_and_percentiles_equal_numpy(spark):
    rng = random.Random(3)
    rows = [(k, v) for k in ("a", "b", None) for v in [rng.choice([rng.gauss(0, 1), 0.5, -2.0, 1e6]) for _ in range(rng.randint(1, 300))]] + [("a", None), ("empty", None)]
    frame = spark.createDataFrame(rows, "k string, v double").repartition(3)
    got = {r.k: r for r in places.percentile(frame, "v", 0.95, "p", "k").collect()}
    assert got.keys() == {"a", "b", None}
    for k, r in got.items():
        values = [v for x, v in rows if x == k and v is not None]
        assert r.n == len(values) and r.p == pytest.approx(np.percentile(values, 95), rel=1e-12)
    all_ = [v for _, v in rows if v is not None]
    assert places.percentile(frame, "v", 0.05, "p").first().p == pytest.approx(np.percentile(all_, 5), rel=1e-12)
    assert places.percentile(frame.where("v is null"), "v", 0.5).collect() == []


def test_omission_effect(spark):
    rows = [
        ("a", 0, True, ["omission"]), ("a", 1, True, ["drift_prev"]), ("b", 0, False, []), ("b", 1, True, ["omission"]), ("c", 0, False, []), ("c", 1, True, ["entailment", "omission"]),
        ("d", 0, True, ["omission"]), ("e", 0, False, []),
    ]
    truth = [("a", True, 0), ("b", True, 0), ("c", True, 1), ("d", False, None), ("e", False, None)]
    got = evaluate.omission_effect(spark.createDataFrame(rows, "run_id string, ordinal int, flagged boolean, flag_codes array<string>"), spark.createDataFrame(truth, "run_id string, truth boolean, origin int")).first()
    assert (got.n, got.n_clean, got.found_without, got.found_with, got.exact_without, got.exact_with) == (3, 2, 2, 3, 1, 2)
    assert (got.within1_without, got.within1_with, got.clean_without, got.clean_with, got.gained, got.improved) == (2, 3, 0, 1, 1, 1)


def test_detection_by_kind_counts_detected_runs_only(spark):
    kind = "kind string, dual_nli boolean, dual boolean, prev boolean, anchor boolean, naive boolean, predicted int, actual int, types array<string>"
    rows = [
        ("causal_leap", True, True, True, False, False, 1, 1, ["retrieval", "inference"]), ("causal_leap", True, False, False, False, False, 3, 1, None),
        ("causal_leap", False, False, False, False, True, 1, 1, ["inference"]), ("context_swap", False, False, False, False, False, None, 2, None),
    ]
    got = {r.kind: r for r in evaluate.detection_table(spark.createDataFrame(rows, kind)).collect()}
    assert (got["causal_leap"].n, got["causal_leap"].exact, got["causal_leap"].within1, got["causal_leap"].right_type) == (3, 0.5, 0.5, 0.5)
    assert got["context_swap"].exact is None and got["total"].n == 4 and got["total"].dual_nli == 0.5 and got["total"].naive == 0.25


def test_levels_of_some_runs_are_applied_to_others(spark):
    rows = [("a", 0.2, 0.3, 0.4), ("a", 0.4, 0.1, None), ("b", 0.6, 0.2, 0.1)]
    own = spark.createDataFrame(rows, "run_id string, drift_prev double, drift_anchor double, aggregate double").withColumn("entailment", F.lit(0.5))
    levels = calibrate.signal_percentiles(own.where("run_id = 'a'"), 100.0)
    got = calibrate.applied(own.where("run_id = 'b'"), levels).first()
    assert (got.prev, got.anchor, got.dual, got.dual_nli) == (True, False, True, False)
    parts = {r.run_id: r.part for r in calibrate.holdout(own.select("run_id").distinct().withColumn("at", F.ascii("run_id")), "at", 1).collect()}
    assert parts == {"a": "calibrate", "b": "holdout"}


def test_data_set_splits(spark):
    own = steps(spark, ["a b", "c d", "e f", "g h"]).unionByName(steps(spark, ["x", "y"], run="s"))
    domains = spark.createDataFrame([("r", "news")], "run_id string, domain string")
    clean = {r.id: r for r in datasets.clean_split(own, domains).collect()}
    assert clean["r"].n_steps == 4 and clean["r"].domain == "news" and clean["s"].domain is None and [s.text for s in clean["s"].steps] == ["x", "y"]
    bad = datasets.injected_split(own, domains, lambda run: F.lit(8)).collect()
    assert len(bad) == 5 and {r.source_id for r in bad} == {"r"} and {r.seed for r in bad} == {8}
    for r in bad:
        assert r.id == f"r--{r.injection_kind}" and [s.text for s in r.steps][r.origin_step_index] == r.injected_text and r.original_text == ["a b", "c d", "e f", "g h"][r.origin_step_index]
    chains = spark.createDataFrame([("r", "q", "src", "m", 0.5), ("s", "q", "src", None, None)], "run_id string, question string, source string, model string, temperature double")
    labels = spark.createDataFrame([("r", True, 1, "omission", None, "n", "consensus")], "run_id string, cascade_occurred boolean, origin_step int, error_type string, evidence string, notes string, label_agreement string")
    passes = spark.createDataFrame([("r", "bob", True, 1, "omission"), ("r", "ann", True, 2, "misread"), ("s", "ann", True, 1, "x"), ("s", "bob", None, None, None)], "run_id string, rater string, cascade_occurred boolean, origin_step int, error_type string")
    got = {r.id: r for r in datasets.labelled_split(own, chains, labels, passes).collect()}
    assert [p.rater for p in got["r"].annotator_labels] == ["ann", "bob"] and got["r"].evidence == "" and got["r"].label_agreement == "consensus"
    assert got["s"].annotator_labels is None and got["s"].label_agreement == "machine_only" and len(got["s"].steps) == 2


def test_facts_join_short_sentences(spark):
    from driftloom.functions.text import facts

    def plain(parts, least):
        out = []
        for p in parts:
            if out and len(p) < least:
                out[-1] += " " + p
            else:
                out.append(p)
        return out

    for text in ("Yes. This sentence is long enough to stand. No. Nor. Another one that is long enough here. End.", "", " ", "One.", "Short. Tiny. Small."):
        parts = [p for p in re.split(r"(?<=[.!?])\s+", text.strip()) if p]
        got = spark.range(1).select(facts(F.lit(text), 12, 25).alias("a"), facts(F.lit(text), 2, 0).alias("b")).first()
        assert got.a == plain(parts, 25) and got.b == parts[:2]
