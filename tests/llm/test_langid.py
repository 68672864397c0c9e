import itertools
import math
import random

import numpy as np

from driftloom.llm import langid

KIND = "doc_id long, text string, lang string, score int"


def test_forward_sums_all_segmentations():
    pieces = ["▁", "▁a", "a", "b", "ab", "▁ab", "ba"]
    index = langid.Index(pieces)
    rng = np.random.default_rng(3)
    prob = np.vstack([rng.random((len(pieces), 2)), np.full((1, 2), langid.UNKNOWN), np.zeros((1, 2))])
    words = ["ab", "aab", "xab", "b", "baba"]
    got = langid.word_scores(words, index, prob)
    for w, row in zip(words, got):
        s, want = "▁" + w, np.zeros(2)
        for cuts in itertools.product([0, 1], repeat=len(s) - 1):
            ends = [i + 1 for i, c in enumerate(cuts) if c] + [len(s)]
            parts = [s[a:b] for a, b in zip([0, *ends], ends)]
            p = np.ones(2)
            for x in parts:
                p = p * (prob[index[x]] if x in index else (langid.UNKNOWN if len(x) == 1 else 0))
            want += p
        assert np.allclose(np.exp(row), want)


def test_expected_counts_raise_the_likelihood():
    pieces = ["▁", "a", "b", "ab", "▁a", "abb"]
    index = langid.Index(pieces)
    words, weight = ["abab", "abba", "aabb"], np.array([5.0, 2.0, 1.0])
    lattice = langid.Lattice(words, index, len(index))
    prob = langid._smoothed(lattice.matches(weight, len(index) + 2)[:, None], 0)
    before = (np.log(lattice.forward(prob)[-1][:, 0]) * weight).sum()
    after = langid._smoothed(lattice.expected(prob, weight)[:, None], 0)
    assert (np.log(lattice.forward(after)[-1][:, 0]) * weight).sum() > before


def test_long_pieces_count():
    import pickle

    pieces = ["▁characteristics", "a", "c", "e", "h", "i", "r", "s", "t", "▁"]
    index = pickle.loads(pickle.dumps(langid.Index(pieces)))
    assert index.longest == 16 and index["▁"] == 9
    prob = np.vstack([np.full((10, 1), 0.1), [[langid.UNKNOWN]], [[0.0]]])
    got = langid.word_scores(["characteristics"], index, prob)[0, 0]
    assert math.isclose(math.exp(got), 0.1 + 0.1**16, rel_tol=1e-9)
    assert max(map(len, langid.vocabulary())) > 12


def test_words():
    assert langid.words_of("Ab1c ²³ _x\n" + "y" * 70) == ["ab", "c", "²³", "x", "y" * 32, "y" * 32, "y" * 6]
    assert langid.words_of("² 12 _ !") == [] and langid.words_of("") == []


def test_held_out_accuracy_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == docs.count()
    out = [r for r in rows if r.held_out]
    assert len(out) > 150 and sum(r.lang == r.lang_pred for r in out) / len(out) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_odd_rows(spark):
    rng = random.Random(1)
    say = lambda w: " ".join(rng.choice(w) for _ in range(30))
    rows = [(i, say(["the", "and", "house"]), "aa", 0) for i in range(20)] + [(100 + i, say(["der", "und", "haus"]), "bb", 0) for i in range(20)]
    rows += [(50, None, "aa", 0), (51, "", None, 0), (52, "123 !!", "aa", 0), (None, "the house", None, 0), (53, "the " * 30_000, "aa", 0), (53, "und der", None, 0)]
    got = langid.identify(spark.createDataFrame(rows, KIND)).collect()
    assert len(got) == len(rows)
    by = {(r.doc_id, r.lang_pred) for r in got}
    assert {(50, "und"), (51, "und"), (52, "und"), (None, "aa"), (53, "aa"), (53, "bb")} <= by
    assert langid.identify(spark.createDataFrame([], KIND)).collect() == []
    unlearnt = langid.identify(spark.createDataFrame([(1, "abc", None, 0)], KIND)).collect()
    assert unlearnt[0].lang_pred == "und" and not math.isnan(unlearnt[0].score)


def test_accepted_rows_keep_all_columns(spark):
    rows = [(i, "the house and the garden", "aa", i) for i in range(30)] + [(40, "12 34", "aa", 7), (41, None, None, 8), (None, "the house", None, 9)]
    got = langid.accepted(spark.createDataFrame(rows, KIND)).collect()
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.score) for r in got) == [(-1, 9)] + [(i, i) for i in range(30)]
