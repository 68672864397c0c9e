import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from driftloom.llm import collocations

KIND = "text string, lang string, phrase int, n string"


def plain(rows, longest=3, least=10, cover=50, top=2000):
    counts, total = {}, Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            words = re.findall("[^ \t]+", piece)
            total[lang] += len(words)
            for k in range(1, longest + 1):
                counts.setdefault(lang, Counter()).update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        within = lambda p, q: len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
        kept = {p: a for p, a in found.items() if not any(within(p, q) and 100 * b >= cover * a for q, b in found.items())}
        scored = []
        for p, a in kept.items():
            score, k = min((1000000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for i, (s, a, p, l, r) in enumerate(sorted(scored)[:top]):
            out.append((lang, i + 1, p.decode(), -a, l, r, total[lang], -s))
    return sorted(out)


def corpus(n=60):
    rng = random.Random(5)
    words = ["the", "THE", "of", "é", "É", "𝔘x", "new", "york", "times", " ", "a", "b\x00"]
    say = lambda: "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", "\r\n", "\x0b"]) for _ in range(rng.randint(0, 60)))
    rows = [(say(), rng.choice(["en", "de", None, "und", ""])) for _ in range(n)]
    return rows + [(None, "en"), ("", None), ("...", "en"), ("New York Times " * 40, "en"), ("one two", "fr")] + rows[:3]


@pytest.mark.parametrize("longest", [2, 3, 5])
@pytest.mark.parametrize("bound", [None, 0])
def test_equals_counting(spark, monkeypatch, longest, bound):
    if bound is not None:  # nothing is pruned by sent words; prefixes are dealt by the next word
        monkeypatch.setattr(collocations, "WORDS", bound)
        monkeypatch.setattr(collocations, "PREFIXES", bound)
    rows = corpus()
    got = collocations.mine(spark.createDataFrame([(*r, 0, "x") for r in rows], KIND).repartition(3), longest, 6, 50, 40)
    assert sorted(tuple(r) for r in got.collect()) == plain(rows, longest, 6, 50, 40)


def test_small_parts_and_heavy_prefixes(spark, monkeypatch):
    for name, value in (("CHUNK", 64), ("TALLY", 10), ("SPLIT", 20)):
        monkeypatch.setattr(collocations, name, value)
    rows = corpus(30) + [("no break " * 200, "en"), ("x " * 500 + ". y", "en")]
    got = collocations.mine(spark.createDataFrame([(*r, 0, "x") for r in rows], KIND), 3, 6, 50, None)
    assert sorted(tuple(r) for r in got.collect()) == plain(rows, 3, 6, 50, None)


def test_nothing(spark):
    assert collocations.mine(spark.createDataFrame([], KIND)).collect() == []
    assert collocations.mine(spark.createDataFrame([("a b", "en", 1, "")], KIND)).collect() == []


def test_scores_of_large_counts(spark):
    rows = [(10**13, 10**13 + 7, 10**14 - 3), (3, 3, 3), (999_999_999_999_999,) * 3, (10, 10**15, 10**15)]
    got = spark.createDataFrame(rows, "a long, l long, r long").select("a", "l", "r", collocations._score(F.col("a"), F.col("l"), F.col("r")).cast("long").alias("s")).collect()
    assert all(r.s == 1000000 * r.a * r.a // (r.l * r.r) for r in got)


def test_words_that_share_a_hash_take_another_seed(spark, monkeypatch):
    """Under the first seed all words would be one."""
    import xxhash

    real = collocations._words

    def clashing(docs, seed):
        words = real(docs, seed)
        return words.withColumn("id", F.lit(7).cast("long")) if seed == 0 else words

    monkeypatch.setattr(collocations, "_words", clashing)
    rows = corpus(20)
    words, seed = collocations._named(spark.createDataFrame(rows, "text string, lang string").fillna("und", ["lang"]))
    assert seed == 1 and words.where(F.col("word") == "york").first().id == (lambda v: v - ((v >> 63) << 64))(xxhash.xxh64_intdigest(b"york", 1))
