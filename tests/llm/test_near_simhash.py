"""The near-duplicate stage meets fingerprints by segment tables, and holds few pairs against whole sets."""

import random

from pyspark.sql import functions as F

from driftloom.llm import nearset
from tests.llm.test_nearset import KIND, similar


def said(rng, n):
    return [f"w{rng.randrange(9000)}" for _ in range(n)]


def test_fingerprints_alone_link_similar_texts(spark, monkeypatch):
    rng = random.Random(5)
    base, other = said(rng, 900), said(rng, 900)
    texts = {1: base, 2: [*base[:-1], "x"], 3: ["y", *base[1:]], 4: other, 5: said(rng, 40)}
    texts = {i: " ".join(t) for i, t in texts.items()}
    prints = nearset._prints
    monkeypatch.setattr(nearset, "_prints", lambda docs, words: prints(docs, words).withColumn("keys", F.array().cast("array<long>")))
    got = {r.doc_id: r.component_id for r in nearset.groups(spark.createDataFrame(list(texts.items()), KIND)).collect()}
    assert similar(texts[1], texts[2]) and got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5}


def test_texts_that_share_keys_but_are_not_similar_make_few_pairs(spark, monkeypatch):
    rng = random.Random(6)
    base = said(rng, 120)
    texts = {i: " ".join(base[:75] + said(rng, 45)) for i in range(80)}  # similarity of about 0.43
    assert not any(similar(texts[0], texts[i]) for i in range(1, 80))
    pairs, verified = [], nearset._similar
    monkeypatch.setattr(nearset, "_similar", lambda p, s: pairs.append(p.count()) or verified(p, s))
    got = {r.doc_id: r.component_id for r in nearset.groups(spark.createDataFrame(list(texts.items()), KIND)).collect()}
    assert got == {i: i for i in texts} and sum(pairs) < 20
