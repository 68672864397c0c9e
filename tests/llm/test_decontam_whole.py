"""All overlaps by brute force, without a condition on seeds."""

import math
import random

from driftloom.llm import decontam
from tests.llm.test_decontam import ITEM, KIND, words


def brute(doc, item, least=15, share=0.8):
    d, b, best = words(doc), words(item), None
    n = min(least, len(b))
    for shift in range(-len(b), len(d)) if n else ():
        on = [i for i in range(len(b)) if 0 <= i + shift < len(d)]
        for a in range(len(on) - n + 1):
            s = sum(b[i] == d[i + shift] for i in on[a : a + n])
            if s >= math.ceil(share * n - 1e-9) and (best is None or s > best):
                best = s
    return best


def held(spark, sizes, count):
    rng = random.Random(sum(sizes))
    items = [(i, " ".join(f"i{i}w{j}" for j in range(n)), 0) for i, n in enumerate(sizes)]
    docs = []
    for i in range(count):
        part = words(rng.choice(items)[1])
        n = min(15, len(part))
        for at in rng.sample(range(n), rng.randint(0, n - math.ceil(0.8 * n - 1e-9) + (rng.random() < 0.2))):
            part[at] = "sub"
        fill = [f"f{rng.randrange(50)}" for _ in range(rng.randint(0, 20))]
        docs.append((i, " ".join(fill + part + fill[:3]), "x", 0))
    got = {(r.doc_id, r.item_id): r.agree for r in decontam.overlaps(spark.createDataFrame(docs, KIND), spark.createDataFrame(items, ITEM)).collect()}
    want = {(d[0], b[0]): s for d in docs for b in items if (s := brute(d[1], b[1])) is not None}
    assert len(want) > count // 2 and got == want


def test_short_items_are_found(spark):
    held(spark, list(range(1, 15)) * 2, 500)


def test_clean_drops_texts_with_a_short_item(spark):
    docs = spark.createDataFrame([(1, "it says What is, the answer? here", "x", 0), (2, "what was the answer", "x", 0), (3, "one two sub four five", "x", 0)], KIND)
    items = spark.createDataFrame([(1, "what is the answer", 0), (2, "one two three four five", 0)], ITEM)
    assert [r.doc_id for r in decontam.clean(docs, items).collect()] == [2]


def test_seeds_meet_all_allowed_substitutions():
    """Every choice of the words that may differ leaves a seed whole, in runs of 8 words and more; shorter ones need none."""
    from itertools import combinations

    counted = [[i for i, c in enumerate(m) if c == "1"] for m in decontam.MASKS]
    for n in range(decontam.SPAN, decontam.LEAST + 1):
        most = n - math.ceil(decontam.SHARE * n - 1e-9)
        for k in range(most + 1):
            for gone in combinations(range(n), k):
                assert any(not any(p + i in gone for i in w) for w in counted for p in range(n - decontam.SPAN + 1)), (n, gone)


def test_runs_of_fifteen_words_and_more(spark):
    held(spark, [15, 16, 18, 22, 30] * 2, 200)
