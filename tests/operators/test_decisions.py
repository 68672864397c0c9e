"""Verdict, classification and attribution on made-up signal rows."""

import pytest
from pyspark.sql import functions as F

from driftloom.config import Profile, Settings
from driftloom.operators import attribute, classify, verdict

KIND = (
    "run_id string, ordinal int, step_id string, step_num long, agent_name string, role string, drift_prev double, drift_anchor double, combined_drift double,"
    "entailment double, contradiction double, certainty double, certainty_delta double, conclusive boolean, coverage double, omission double, aggregate double, flagged boolean, flag_reasons array<string>"
)


def rows(spark, *steps, run="r"):
    base = {"drift_prev": None, "drift_anchor": None, "entailment": None, "certainty_delta": 0.0, "conclusive": False, "omission": None, "aggregate": None, "flagged": False, "role": "llm"}
    out = []
    for i, s in enumerate(steps):
        s = base | s
        ident = str(s.get("step_id", i + 1))
        out.append((run, i, ident, int(ident) if ident.isdigit() else None, f"agent{i + 1}", s["role"], s["drift_prev"], s["drift_anchor"], 0.0, s["entailment"], None, 0.0, s["certainty_delta"], s["conclusive"], None, s["omission"], s["aggregate"], s["flagged"], []))
    return spark.createDataFrame(out, KIND)


OFF = dict(aggregate_threshold=9.0, entail_collapse=None, omission_collapse=None, drift_collapse=None)


@pytest.mark.parametrize(
    ("levels", "step", "code"),
    [
        ({"aggregate_threshold": 0.5}, {"aggregate": 0.6}, "aggregate"), ({"entail_collapse": 0.01}, {"entailment": 0.001}, "entailment"),
        ({"omission_collapse": 0.3}, {"omission": 0.4}, "omission"), ({"drift_collapse": 0.9}, {"drift_anchor": 0.95}, "drift_anchor"),
    ],
)
def test_each_trigger_alone(spark, levels, step, code):
    own = rows(spark, {}, step)
    got = verdict.verdicts(own, Profile(**(OFF | levels))).first()
    assert got.verdict and got.verdict_codes == [code] and got.verdict_reasons[0].endswith("at step 2")
    assert not verdict.verdicts(own, Profile(**OFF)).first().verdict


def test_levels_are_strict_and_ties_go_by_step(spark):
    own = rows(spark, {"aggregate": 0.5, "entailment": 0.005}, {"aggregate": 0.7, "entailment": 0.001}, {"aggregate": 0.7, "entailment": 0.001}, {"step_id": 10, "aggregate": 0.7, "entailment": 0.5})
    got = verdict.verdicts(own, Profile(**(OFF | {"aggregate_threshold": 0.5, "entail_collapse": 0.01}))).first()
    assert [r.rsplit(" ", 1)[1] for r in got.verdict_reasons] == ["10", "2"]
    assert not verdict.verdicts(rows(spark, {"aggregate": 0.5}), Profile(**(OFF | {"aggregate_threshold": 0.5}))).first().verdict


def scores(spark, *steps, nli=True, t=0.3, tau=0.72, **more):
    settings = Settings(profile=Profile(drift_threshold=t, entail_threshold=tau), **more)
    own = classify.rule_scores(rows(spark, *steps), settings, nli)
    return own.first(), [(c.cascade_type, round(c.confidence, 6)) for c in classify.classification(own, settings.class_cutoff).first().classification]


def test_retrieval(spark):
    got, kinds = scores(spark, {}, {"drift_anchor": 0.9}, {"drift_anchor": 0.9}, {"drift_anchor": 0.1})
    assert got.retrieval == 1.0 and kinds[0] == ("retrieval", 1.0)


def test_inference_with_and_without_entailment(spark):
    steps = [{}, {"drift_anchor": 0.1, "entailment": 0.9}, {"drift_anchor": 0.2, "entailment": 0.18, "conclusive": True}, {"drift_anchor": 0.3, "entailment": 0.0}]
    got, _ = scores(spark, *steps)
    assert got.inference == pytest.approx(0.7 * 0.75 + 0.3) and "step 3" in got.rationales[1]
    got, _ = scores(spark, *steps, nli=False)
    assert got.inference == pytest.approx(0.7) and "100%" in got.rationales[1]


def test_poisoning_takes_the_first_largest_jump_and_outside_roles(spark):
    steps = [{}, {"drift_anchor": 0.1}, {"drift_anchor": 0.4}, {"drift_anchor": 0.1}, {"drift_anchor": 0.4}]
    got, _ = scores(spark, *steps)
    assert got.context_poisoning == pytest.approx(0.5) and got.rationales[2].endswith("step 3")
    steps[4] = steps[4] | {"role": "Tool"}
    got, _ = scores(spark, *steps)
    assert got.context_poisoning == pytest.approx(0.75) and got.rationales[2].endswith("step 5 on externally-sourced content")
    got, _ = scores(spark, *steps, external_roles=("memory",))
    assert got.context_poisoning == pytest.approx(0.5)


def test_inflation_is_halved_unless_the_anchor_drift_rises(spark):
    up = [{}, {"drift_anchor": 0.1, "certainty_delta": 0.5}, {"drift_anchor": 0.2, "certainty_delta": 0.3}]
    assert scores(spark, *up)[0].confidence_inflation == pytest.approx(0.8)
    flat = [{}, {"drift_anchor": 0.2, "certainty_delta": 0.5}, {"drift_anchor": 0.2, "certainty_delta": 0.3}]
    assert scores(spark, *flat)[0].confidence_inflation == pytest.approx(0.4)


def test_selection(spark):
    _, kinds = scores(spark, {}, {"drift_anchor": 0.35})
    assert kinds == []
    _, kinds = scores(spark, {}, {"drift_anchor": 0.35, "flagged": True})
    assert kinds == [("retrieval", pytest.approx(0.083333))]
    _, kinds = scores(spark, {}, {"drift_anchor": 0.1, "flagged": True})
    assert kinds == []
    _, kinds = scores(spark, {}, {"drift_anchor": 0.0}, {"drift_anchor": 2.0, "certainty_delta": 1.0})
    assert [k for k, _ in kinds] == ["retrieval", "context_poisoning", "confidence_inflation"]


def test_candidates(spark):
    own = rows(spark, {}, {"drift_prev": 0.45, "drift_anchor": 0.2, "entailment": 0.9}, {"drift_prev": 0.9, "drift_anchor": 0.9, "entailment": 0.1}, {"drift_prev": 0.1, "drift_anchor": 0.1, "entailment": 0.8})
    got = attribute.candidates(own, Settings(profile=Profile(drift_threshold=0.3))).orderBy("ordinal").collect()
    assert [(r.step_id, r.crossed, r.confidence) for r in got] == [("2", 1, 0.5), ("3", 3, 1.0)]
    got = attribute.candidates(own, Settings(profile=Profile(drift_threshold=0.3)), nli=False).orderBy("ordinal").collect()
    assert [(r.crossed, r.confidence) for r in got] == [(1, 0.6), (2, 1.0)]
    assert attribute.candidates(own.where(F.lit(False))).count() == 0
    assert attribute.candidates(own, Settings(profile=Profile(drift_threshold=0.0))).where("confidence is null").count() > 0
