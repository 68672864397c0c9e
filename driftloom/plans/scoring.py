"""Queries of models' scores: kept ones, and failures that stay where they are.

The models are stand-ins that can be stated in SQL: a text's vector counts five
letters, and a pair is judged by the lengths of its texts.
"""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import functions as F

from ..operators import models, report, scorers
from ..operators.steps import densified
from ..sources.shared import shared_dir, written
from .demo import SETTINGS as DEMO
from .demo import all_steps, r6, steps
from .wider import first_texts

LETTERS = "eaint"
#: Each sentence of an anchor is a fact.
SETTINGS = replace(DEMO, min_fact_chars=0)
#: Texts longer than the first can't be embedded; premises, and facts' steps, of certain lengths can't be judged.
TOO_LONG, ODD, ROUND = 1200, 97, 89


def letters():
    return lambda texts: [[float(t.count(c)) for c in LETTERS] + [1.0] for t in texts]


def lengths():
    def judge(pairs):
        shares = [min(len(p), len(h)) / max(len(p), len(h), 1) for p, h in pairs]
        return [(e, (1 - e) * 0.7, (1 - e) * 0.3) for e in shares]

    return judge


def model_scores_kept(spark, sf_dir):
    """Drift and entailment of a second analysis, of which no text and no pair is scored again."""
    own = steps(spark, sf_dir)
    folder = f"{shared_dir(spark)}/scores-{uuid.uuid4().hex}"
    calls = spark.sparkContext.accumulator(0)

    def counted(load):
        def loader():
            call = load()

            def counting(rows):
                calls.add(len(rows))
                return call(rows)

            return counting

        return loader

    said = []
    for _ in range(2):
        before = calls.value
        drift, _ = models.model_drift(own, counted(letters), kept=scorers.ScoreTable(spark, folder, "letters"))
        judged, _ = models.model_entailment(own, counted(lengths), kept=scorers.ScoreTable(spark, folder, "lengths"))
        found = written(drift.join(judged.select("run_id", "ordinal", "entailment"), ["run_id", "ordinal"], "left"), "analysis")
        said.append(calls.value - before)
    return found.select("run_id", F.col("ordinal").cast("long").alias("ordinal"), *[r6(c).alias(c) for c in ("drift_prev", "drift_anchor", "entailment")], F.lit(said[0] > 0).alias("scored"), F.lit(said[1]).cast("long").alias("scored_again"))


def failure_scopes(spark, sf_dir):
    """Reports where models fail on some texts: what each run loses, and which notes it has."""
    own = all_steps(spark, sf_dir)

    def embed():
        call = letters()

        def shaky(texts):
            if any(len(t) > TOO_LONG for t in texts):
                raise ValueError("text too long")
            return call(texts)

        return shaky

    def judge():
        call = lengths()

        def shaky(pairs):
            if any(len(p) % ODD == 0 or len(p) % ROUND == 0 and len(h) < 200 for p, h in pairs):
                raise ValueError("can't judge this")
            return call(pairs)

        return shaky

    anchors = first_texts(densified(own))
    options = models.scores(own, embed, judge, anchors, SETTINGS)
    _, found = report.analyze(own, SETTINGS, anchors, **options)
    has = lambda text: F.exists("notes", lambda n: n.contains(text))
    return found.select(
        "run_id", F.col("monitoring_failure").isNotNull().alias("failed"), F.coalesce("monitoring_failure", F.lit("")).alias("why"), "degraded", F.size("steps").cast("long").alias("n_steps"),
        F.exists("steps", lambda s: s["coverage"].isNotNull()).alias("covered"), has("entailment failed").alias("unjudged"), has("coverage failed").alias("uncovered"), F.coalesce("models.nli", F.lit("")).alias("nli"),
    )


QUERIES = {f.__name__: f for f in (model_scores_kept, failure_scopes)}
