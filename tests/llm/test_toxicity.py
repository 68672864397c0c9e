import math
import random
import zlib

import numpy as np

from driftloom.llm import toxicity

KIND = "doc_id long, text string, score int"


def corpus(n=700, seed=2):
    rng = random.Random(seed)
    plain = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 9))) for _ in range(150)]
    rows = []
    for i in range(n):
        words = [rng.choice(plain) for _ in range(rng.randint(5, 150))]
        bad = i % 4 == 0
        if bad:
            for _ in range(3):
                words.insert(rng.randrange(len(words) + 1), rng.choice(["vile", "zzgrob" + rng.choice(plain)]))
        rows.append((i, " ".join(words), int(bad)))
    return rows


def test_gradients_equal_differences():
    net = toxicity.Network({"aa": 0, "bb": 1}, {"aa": 1.0}, {})
    windows, labels = [["aa", "bb", "cc", "aa"], ["bb", "dd"], ["cc", "cc", "aa"]], [1, 0, 1]
    _, g = net.gradients(windows, labels)
    rng = np.random.default_rng(0)
    for k, x in net.p.items():
        flat, own = x.reshape(-1), g[k].reshape(-1)
        for i in {int(np.abs(own).argmax()), *map(int, rng.integers(0, len(flat), 4))}:
            was = flat[i]
            flat[i] = was + 1e-5
            up = net.gradients(windows, labels)[0]
            flat[i] = was - 1e-5
            down = net.gradients(windows, labels)[0]
            flat[i] = was
            assert abs((up - down) / 2e-5 - own[i]) < 1e-6, k


def test_scores_equal_plain_loops():
    """Inputs, both recurrent layers, attention and the highest window, word by word in plain Python."""
    rng = random.Random(6)
    net = toxicity.Network({"aa": 0, "bb": 1}, {"aa": 1.0}, {b"^cc": 0.5, b"ccc": 0.25})
    p, h = {k: v.tolist() for k, v in net.p.items()}, toxicity.STATE
    sigmoid = lambda x: 1 / (1 + math.exp(-x))

    def described(word):
        marked = b"^" + word.encode()
        grams = [marked[i : i + 4] for i in range(max(1, len(marked) - 3))] + [marked[:n] for n in (5, 6, 7) if n < len(marked)]
        mean = [sum(p["gram"][zlib.crc32(g) % toxicity.BUCKETS][j] for g in grams) / len(grams) for j in range(toxicity.VECTOR)]
        best = sorted((net.lean_gram.get(g, 0.0) for g in grams), reverse=True)[:2]
        return p["word"][net.words.get(word, 2)] + mean + [net.lean_word.get(word, 0.0), sum(best) / 2]

    def layer(xs, d):
        s, out = [0.0] * h, []
        for x in xs:
            xw = [sum(x[i] * p["W" + d][i][j] for i in range(len(x))) + p["B" + d][j] for j in range(3 * h)]
            su = [sum(s[i] * p["U" + d][i][j] for i in range(h)) for j in range(3 * h)]
            z = [sigmoid(xw[j] + su[j]) for j in range(h)]
            r = [sigmoid(xw[h + j] + su[h + j]) for j in range(h)]
            c = [math.tanh(xw[2 * h + j] + r[j] * su[2 * h + j]) for j in range(h)]
            s = [s[j] + z[j] * (c[j] - s[j]) for j in range(h)]
            out.append(s)
        return out

    def window(words):
        xs = [described(w) for w in words]
        states = [a + b for a, b in zip(layer(xs, "f"), layer(xs[::-1], "b")[::-1])]
        e = [math.exp(sum(x * y for x, y in zip(s, p["att"]))) for s in states]
        pooled = [sum(w * s[j] for w, s in zip(e, states)) / sum(e) for j in range(2 * h)]
        return sigmoid(sum(x * y for x, y in zip(pooled, p["out"])) + p["bias"][0])

    def plain(text):
        words = text.lower().split()
        starts = sorted({min(a, max(0, len(words) - 32)) for a in range(0, max(1, len(words) - 16), 16)}) if words else []
        return max((window(words[a : a + 32]) for a in starts), default=0.0)

    texts = [" ".join(rng.choice(["aa", "bb", "ccc", "dd", "é" * 120, "longerword"]) for _ in range(n)) for n in (0, 1, 5, 31, 32, 33, 48, 49, 70, 130)]
    got = toxicity.Scorer(net).score(texts)
    assert all(abs(a - plain(t)) < 1e-4 for a, t in zip(got, texts))


def test_leanings_leave_out_a_fold():
    docs, labels = [["vile", "x"]] * 10 + [["x", "y"]] * 30, [1] * 10 + [0] * 30
    lean = toxicity.Leanings(docs, labels, folds=5)
    assert sorted(lean.fold_of[:10]) == sorted(list(range(5)) * 2)
    words, grams = lean.told()
    assert words["vile"] > 0 and "x" not in words and grams[b"vile"] > 0
    docs[0] = ["only", "here"]
    lean = toxicity.Leanings([["rare"] if i in (0, 5, 1) else d for i, d in enumerate(docs)], labels, folds=5)
    assert "rare" in lean.told()[0] and "rare" not in lean.told(lean.fold_of[0])[0]


def test_conflicting_labels_are_decided(spark):
    docs = spark.createDataFrame([(1, "b"), (1, "a"), (2, "c")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, None), (2, 0)], "doc_id long, toxic int")
    seen = []
    was, toxicity.train = toxicity.train, lambda texts, marks: seen.append((texts, marks))
    try:
        toxicity.learn(docs, labels)
    finally:
        toxicity.train = was
    assert seen == [(["a", "c"], [1, 0])]


def test_all_windows_are_scored():
    net = toxicity.Network({}, {}, {})
    scorer = toxicity.Scorer(net)
    texts = ["w" * (i + 1) + " " for i in range(8)]
    texts = [t * n for t, n in zip(texts, [0, 1, 31, 32, 33, 48, 49, 200])] + [" ".join("x" * i for i in range(1, 78))]
    _, scores, firsts, counts = scorer.windows(texts)
    assert counts == [0, 1, 1, 1, 2, 2, 3, 12, 4]
    assert len(scores) == sum(counts) and (scores > 0).all()


def test_held_out_accuracy(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, 0) for i, t, _ in rows], KIND)
    labels = spark.createDataFrame([(i, y, 1) for i, _, y in rows], "doc_id long, toxic int, quality int")
    truth = {i: y for i, _, y in rows}
    got = toxicity.detect(docs, labels).collect()
    assert len(got) == len(rows)
    out = [r for r in got if r.held_out]
    assert {r.doc_id for r in out} == {i for i in truth if zlib.crc32(str(i).encode()) % 3 == 1}
    assert sum(r.predicted == truth[r.doc_id] for r in out) / len(out) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)


def test_odd_rows(spark):
    rows = [(1, None, 0), (2, "", 0), (3, "12 !?", 0), (None, "x y", 0), (4, "word " * 40_000, 0), (4, "a" * 100_000, 0)]
    docs = spark.createDataFrame(rows, KIND)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    got = toxicity.detect(docs, none).collect()
    assert len(got) == 6 and all(r.score == 0 for r in got)
    net = toxicity.train([t for _, t, _ in corpus(200)], [y for *_, y in corpus(200)], rounds=1, steps=20)
    got = toxicity.predict(docs, net).collect()
    assert len(got) == 6 and {r.score for r in got if r.doc_id in (1, 2, 3)} == {0.0}
    assert toxicity.predict(docs.limit(0), net).collect() == []
