import random
import re

import corpus_pipeline

from driftloom.llm import nearset

KIND = "doc_id long, text string"


def shingles(text, words=5):
    found = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    return {" ".join(found[i : i + words]) for i in range(len(found) - words + 1)} or ({" ".join(found)} if found else set())


def similar(a, b):
    x, y = shingles(a), shingles(b)
    return x == y or 5 * len(x & y) >= 4 * len(x | y)


def brute(texts):
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    pairs = 0
    for a in texts:
        for b in texts:
            if a < b and similar(texts[a], texts[b]):
                pairs += texts[a] != texts[b]
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in texts}, pairs


def corpus():
    rng = random.Random(3)
    say = lambda n: [f"w{rng.randrange(4000)}" for _ in range(n)]
    texts = []
    for _ in range(12):
        base = say(rng.choice([3, 6, 20, 60, 150]))
        for _ in range(rng.randint(1, 12)):
            own = list(base)
            for _ in range(rng.randint(0, max(1, len(own) // 30))):
                own[rng.randrange(len(own))] = rng.choice(["sub", "x1", "x2"])
            texts.append(" ".join(own))
    chain = say(120)  # each is like the next only
    texts += [" ".join(chain[4 * i : 4 * i + 60]) for i in range(14)]
    texts += [None, "", " \n", "solo", "SOLO ", "one two"]
    rng.shuffle(texts)
    return dict(enumerate(texts))


def test_groups_equal_brute_force_jaccard(spark):
    texts = corpus()
    want, pairs = brute(texts)
    assert pairs > 40 and len(set(want.values())) > 12
    got = {r.doc_id: r.component_id for r in nearset.groups(spark.createDataFrame(list(texts.items()), KIND)).collect()}
    assert got == want


def test_stage_drops_near_copies_that_are_many_bits_apart(spark):
    texts = corpus()
    want, _ = brute(texts)
    docs = spark.createDataFrame([(i, t, 1) for i, t in texts.items()], KIND + ", other int")
    kept = corpus_pipeline.near_dedup(spark, docs, "")
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i in texts if want[i] == i}


def test_pairs_that_no_star_links_are_compared(spark, monkeypatch):
    monkeypatch.setattr(nearset, "STARS", 0)
    texts = corpus()
    got = {r.doc_id: r.component_id for r in nearset.groups(spark.createDataFrame(list(texts.items()), KIND)).collect()}
    assert got == brute(texts)[0]


def test_no_rows_and_null_ids(spark):
    assert nearset.groups(spark.createDataFrame([], KIND)).collect() == []
    docs = spark.createDataFrame([(None, "a b c d"), (3, "a b c d"), (3, "a b c d"), (None, "zz")], KIND)
    assert sorted((str(r.doc_id), str(r.component_id)) for r in nearset.groups(docs).collect()) == [("3", "3"), ("3", "3"), ("None", "3"), ("None", "None")]
    assert nearset.keep_one(docs).count() == 4


def test_prefixes_find_all_similar_sets_and_few_others(spark):
    """A crowd of sets that are all a little less alike than the limit, and some that are alike, makes few candidates."""
    rng = random.Random(8)
    base = [rng.getrandbits(60) for _ in range(90)]
    own = lambda k: [rng.getrandbits(60) for _ in range(k)]
    sets = {i: set(base[:70] + own(rng.choice([18, 20, 25]))) for i in range(300)}  # overlaps of 0.61 to 0.65
    for i in range(300, 330):
        sets[i] = set(rng.sample(base, rng.randint(75, 90)) + own(rng.randint(0, 9)))
    for i in range(330, 345):
        sets[i] = set(rng.sample(base, 3))
    sets |= {400: set(), 401: set(own(5))}
    frame = spark.createDataFrame([(i, sorted(x)) for i, x in sets.items()], "node long, shingles array<long>")
    nodes = spark.createDataFrame([(i, i) for i in sets], "node long, root long")
    got = [tuple(r) for r in nearset.prefix_pairs(nodes, frame).collect()]
    want = {(a, b) for a in sets for b in sets if a < b and sets[a] & sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])}
    assert len(want) > 30 and want <= set(got)
    assert len(set(got)) < 3 * len(sets)  # of 60,000 pairs
