"""Hand-worked cases of the per-step signals."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from driftloom.config import Lexicon, Profile, Settings, Weights
from driftloom.functions import text as T
from driftloom.functions import vectors as V
from driftloom.operators import drift, report, signals
from driftloom.operators.scorers import bucket_vector, embed_with, judge_with, overlap_entailment
from driftloom.operators.steps import densified, skip_notes

KIND = "run_id string, pos int, step_id string, agent_name string, role string, text string"


def steps(spark, texts, run="r", roles=None, ids=None):
    rows = [(run, i, str(ids[i] if ids else i + 1), "a", roles[i] if roles else "llm", t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, KIND)


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_blank_tests_follow_unicode(spark):
    texts = ["a", "", " ", "\t\n", " ", " ", "\x1c\x1f", "\x85", "​", None, " x "]
    got = [r.m for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(T.measurable(F.col("t")).alias("m")).collect()]
    assert got == [bool(t and t.strip()) for t in texts]


def test_drift_of_three_steps(spark):
    own = densified(steps(spark, ["alpha beta gamma", "alpha beta delta", "zulu yankee xray"]))
    for buckets in (None, 128):
        rows = {r.ordinal: r for r in drift.bag_drift(own, buckets=buckets).collect()}
        assert rows[0].drift_prev is None and rows[0].drift_anchor is None and rows[0].combined_drift == 0
        assert rows[1].drift_prev == pytest.approx(1 / 3) and rows[2].drift_prev == pytest.approx(1.0) and rows[2].drift_anchor == pytest.approx(1.0)
    assert drift.most_drifted(drift.bag_drift(own)).first().ordinal == 2


def test_blank_steps_are_passed_over_and_noted(spark):
    raw = steps(spark, ["a b", "  ", "a b"]).unionByName(steps(spark, ["", None], run="empty"))
    own = densified(raw)
    assert [(r.run_id, r.ordinal, r.step_id) for r in own.orderBy("ordinal").collect()] == [("r", 0, "1"), ("r", 1, "3")]
    assert drift.bag_drift(own).where("ordinal = 1").first().drift_prev == pytest.approx(0)
    notes = [(r.run_id, r.code) for r in skip_notes(raw).orderBy("run_id", "stage", "pos").collect()]
    assert notes == [("empty", "skipped"), ("empty", "skipped"), ("empty", "empty"), ("r", "skipped")]


def test_given_anchors(spark):
    own = densified(steps(spark, ["a b", "c d", "a d"]))
    anchors = spark.createDataFrame([("r", ["a a", "d d"])], "run_id string, texts array<string>")
    rows = {r.ordinal: r for r in drift.bag_drift(own, anchors).collect()}
    assert rows[0].drift_prev is None and rows[0].drift_anchor == pytest.approx(0.5)
    assert rows[2].drift_anchor == pytest.approx(0)


def test_sparse_equals_dense(spark):
    own = densified(steps(spark, ["one two two", "two three", "one one", "four"])).withColumn("v", bucket_vector(F.col("text")))
    a = {r.ordinal: r for r in drift.bag_drift(own, buckets=128).collect()}
    b = {r.ordinal: r for r in drift.dense_drift(own, "v").collect()}
    for i in range(4):
        assert a[i].drift_prev == pytest.approx(b[i].drift_prev) and a[i].drift_anchor == pytest.approx(b[i].drift_anchor)


def test_vector_expressions(spark):
    arr = lambda *x: F.array(*map(F.lit, x))
    assert value(spark, V.cosine(arr(0.0, 0.0), arr(1.0, 0.0))) == 0.0
    assert value(spark, V.cosine(arr(3.0, 4.0), arr(3.0, 4.0))) == pytest.approx(1.0)
    assert value(spark, V.mean_vector(F.array(arr(1.0, 2.0), arr(3.0, 6.0)))) == [2.0, 4.0]
    assert sum(value(spark, V.softmax(arr(1.0, 2.0, 900.0)))) == pytest.approx(1.0)
    assert value(spark, V.clip(F.lit(None).cast("double"))) is None and value(spark, V.clip(F.lit(3.0))) == 1.0
    assert value(spark, V.ratio(F.lit(1.0), F.lit(0.0))) is None
    assert value(spark, V.entailment_label(F.lit(0.4), F.lit(0.4), F.lit(0.2))) == "entailment"
    assert value(spark, V.weighted_mean((F.lit(None).cast("double"), 0.4), (F.lit(0.5), 0.4), (F.lit(1.0), 0.2))) == pytest.approx(0.4 / 0.6)
    assert value(spark, V.weighted_mean((F.lit(None).cast("double"), 0.4))) is None


@pytest.mark.parametrize(
    ("text", "hedge", "certain", "conclusive"),
    [
        ("this might possibly work", 2, 0, False), ("therefore it is definitely clearly so", 0, 2, True), ("Belum pasti benar", 1, 0, False),
        ("it may become so", 1, 0, False), ("as a result we stop", 0, 0, True), ("sudah pasti jelas", 0, 2, False), ("", 0, 0, False), ("kira-kira dua", 1, 0, False),
    ],
)
def test_certainty(spark, text, hedge, certain, conclusive):
    got = value(spark, T.certainty(F.lit(text)))
    assert (got.hedge_hits, got.certainty_hits, got.conclusive) == (hedge, certain, conclusive)


def test_certainty_scores_and_rise(spark):
    rows = signals.certainties(densified(steps(spark, ["perhaps it might rain", "it will definitely surely rain"]))).orderBy("ordinal").collect()
    assert rows[0].certainty_delta == 0 and rows[1].certainty_delta == 1.0 and rows[0].score == -1.0 and rows[1].score == 1.0


def test_facts(spark):
    text = "The first sentence is long enough. Tiny one. The price is 0.12 dollars per unit today! Is this the last sentence of all?"
    got = value(spark, T.facts(F.lit(text), 12, 25))
    assert got == ["The first sentence is long enough. Tiny one.", "The price is 0.12 dollars per unit today!", "Is this the last sentence of all?"]
    assert value(spark, T.facts(F.lit(text), 1, 25)) == got[:1] and value(spark, T.facts(F.lit("  "), 3, 25)) == []
    assert value(spark, T.facts(F.lit("No. But this one follows it, joined to nothing."), 5, 25)) == ["No.", "But this one follows it, joined to nothing."]
    assert value(spark, T.listed_facts(F.array(F.lit(" a "), F.lit(" "), F.lit("b")), 5)) == ["a", "b"]


@pytest.mark.parametrize(("covered", "lost"), [([0.6], [0.4]), ([1, 0.5, 0.5], [0, 0.5, 0]), ([0.5, 1], [0.5, 0])])
def test_omission_is_loss_since_the_step_before(spark, covered, lost):
    facts = [f"fact{i}" for i in range(10)]
    texts = [" ".join([*facts[: int(10 * c)], "filler"]) for c in covered]
    anchors = spark.createDataFrame([("r", "list", facts)], "run_id string, kind string, texts array<string>")
    own = densified(steps(spark, texts))
    rows = signals.coverage(own, signals.anchor_facts(anchors), 0.5).orderBy("ordinal").collect()
    assert [r.coverage for r in rows] == pytest.approx(covered) and [r.omission for r in rows] == pytest.approx(lost)


def test_overlap_entailment(spark):
    got = value(spark, overlap_entailment(F.lit("a b c"), F.lit("a b x y")))
    assert (got.entailment, got.neutral, got.contradiction) == pytest.approx((0.5, 0.35, 0.15))
    assert value(spark, overlap_entailment(F.lit("a"), F.lit("a")))["entailment"] == 0.95 and value(spark, overlap_entailment(F.lit("a"), F.lit("b")))["entailment"] == 0.05
    assert value(spark, overlap_entailment(F.lit(None).cast("string"), F.lit("b"))) is None


def test_whole_report(spark):
    own = steps(spark, ["alpha beta gamma delta", "alpha beta gamma zulu", "yankee xray whiskey victor"])
    settings = Settings(profile=Profile(drift_threshold=0.3, aggregate_threshold=0.5))
    rows, reports = report.analyze(own, settings)
    by = {r.ordinal: r for r in rows.collect()}
    assert by[0].aggregate is None and by[1].aggregate == pytest.approx(0.2) and by[2].aggregate == pytest.approx(0.78)
    assert by[2].flag_codes == ["drift_prev", "drift_anchor", "entailment", "aggregate"] and by[2].flag_reasons[0] == "drift_prev 1.000 > threshold 0.3"
    r = reports.first()
    assert r.verdict and r.verdict_reasons == ["aggregate 0.780 > 0.5 at step 3", "anchor drift 1.000 > 0.9 at step 3"]
    assert [(c.cascade_type, round(c.confidence, 6)) for c in r.classification] == [("context_poisoning", 1.0), ("retrieval", 0.541667)]
    assert [(c.origin_step, c.confidence) for c in r.attribution] == [("3", 1.0)] and not r.degraded


def test_degraded_and_empty_runs(spark):
    own = steps(spark, ["only one step"], run="one").unionByName(steps(spark, [" "], run="none"))
    _, reports = report.analyze(own)
    by = {r.run_id: r for r in reports.collect()}
    assert by["one"].degraded and by["one"].models.nli is None and not by["one"].verdict
    assert by["none"].steps == [] and any("no measurable steps" in n for n in by["none"].notes)
    _, reports = report.analyze(own, nli=False)
    assert not any(r.degraded for r in reports.collect())
    zero = Settings(profile=Profile(drift_threshold=0.0, aggregate_threshold=0.1))
    r = report.analyze(steps(spark, ["a b", "c d"]), zero)[1].first()
    assert r.monitoring_failure and not r.verdict and r.steps == [] and r.degraded


def test_weights_and_lexicon_are_settings(spark):
    own = densified(steps(spark, ["foo x", "bar x"]))
    settings = replace(Settings(), lexicon=Lexicon(hedge_words=("foo",), certainty_words=("bar",)), weights=Weights(0, 0, 1))
    assert signals.signals(own, settings).where("ordinal = 1").first().aggregate == 1.0


def test_model_adapters_contain_failures(spark):
    own = densified(steps(spark, ["good", "bad", "good"]))

    def load():
        def embed(texts):
            if any(t == "bad" for t in texts):
                raise RuntimeError("model exploded")
            return [[1.0, float(len(t))] for t in texts]

        return embed

    rows = {r.ordinal: r for r in embed_with(own, "text", load).collect()}
    assert rows[0].vector == [1.0, 4.0] and rows[1].vector is None and "model exploded" in rows[1].error and rows[2].error is None
    pairs = spark.createDataFrame([("a", "b"), ("a", "x"), (None, "b")], "p string, h string")

    def judge():
        def call(some):
            if any(h == "x" for _, h in some):
                raise ValueError("no")
            return [(0.7, 0.2, 0.1)] * len(some)

        return call

    got = {(r.p, r.h): (r.entailment, r.error) for r in judge_with(pairs, "p", "h", judge).collect()}
    assert got == {("a", "b"): (0.7, None), ("a", "x"): (None, "ValueError: no"), (None, "b"): (None, None)}


def test_text_predicates(spark):
    assert value(spark, T.truncated(F.lit("it stops here"))) and not value(spark, T.truncated(F.lit("done. ")))
    assert value(spark, T.squeezed(F.lit("  a  b\n c "))) == "a b c"
    assert value(spark, T.contains_any(F.lit("Apakah ini"), ("apakah",))) and value(spark, T.batch_number(F.lit("organic-09"))) == 9
    assert [value(spark, T.reason_signal(F.lit(x))) for x in ("omission 1", "entailment 1", "aggregate 1", "drift_prev 1")] == ["omission", "entailment", "aggregate", "drift"]


def test_failures_stay_with_their_runs(spark):
    from driftloom.operators import models

    own = steps(spark, ["a b", "a c", "d e"], run="fine").unionByName(steps(spark, ["a b", "EMBED", "c"], run="lost")).unionByName(steps(spark, ["a b", "JUDGE", "c d"], run="mute"))
    anchors = spark.createDataFrame([(r, "text", ["a b is the first thing said here."]) for r in ("fine", "lost", "mute")], "run_id string, kind string, texts array<string>")

    def embed():
        def call(texts):
            if "EMBED" in texts:
                raise RuntimeError("model exploded")
            return [[float("a" in t), float("c" in t), 1.0] for t in texts]

        return call

    def judge():
        def call(pairs):
            if any("JUDGE" in p for p, _ in pairs):
                raise RuntimeError("judge exploded")
            return [(0.001, 0.5, 0.499)] * len(pairs)

        return call

    options = models.scores(own, embed, judge, anchors)
    _, reports = report.analyze(own, anchors=anchors, **options)
    by = {r.run_id: r for r in reports.collect()}
    assert by["fine"].verdict and not by["fine"].degraded and by["fine"].models.nli == "model" and by["fine"].steps[1].coverage == 0.0
    assert "model exploded" in by["lost"].monitoring_failure and by["lost"].steps == [] and by["lost"].degraded and not by["lost"].verdict
    assert by["mute"].degraded and by["mute"].models.nli is None and by["mute"].steps[1].drift_prev is not None and by["mute"].steps[1].coverage is None
    assert sum("exploded" in n for n in by["mute"].notes) == 2
