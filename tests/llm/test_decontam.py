import random
import re

from driftloom.llm import decontam

KIND = "doc_id long, text string, item_id string, words int"
ITEM = "item_id long, text string, doc_id int"


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def plain(doc, item, least=15, share=0.8):
    """Best agreement of any aligned run, where some seed of the run's alignment hits."""
    d, b, best = words(doc), words(item), None
    n = min(least, len(b))
    for shift in range(-len(b), len(d)):
        on = [i for i in range(len(b)) if 0 <= i + shift < len(d)]
        if len(on) < n or not n:
            continue
        seed = any(all(0 <= p + j + shift < len(d) and b[p + j] == d[p + j + shift] for j, c in enumerate(m) if c == "1") for m in decontam.MASKS for p in range(len(b) - 7) if p in on and p + 7 in on)
        if not seed:
            continue
        for a in range(len(on) - n + 1):
            s = sum(b[i] == d[i + shift] for i in on[a : a + n])
            if s >= share * n - 1e-9 and (best is None or s > best):
                best = s
    return best


def test_equals_brute_force(spark):
    rng = random.Random(8)
    vocab = [f"w{i}" for i in range(60)] + ["the"] * 20
    say = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = [(i, " ".join(say(rng.choice([5, 8, 9, 14, 15, 30, 60]))), 0) for i in range(25)] + [(90, None, 0), (91, "", 0), (None, "w1 " * 30, 0)]
    docs = [(0, None, "x", 0), (1, "", "x", 0), (2, "only", "x", 0)]
    for i in range(3, 120):
        body = say(rng.randint(0, 60))
        if i % 2:
            part = words(rng.choice(items[:25])[1])
            part = [w if rng.random() > 0.12 else "sub" for w in part][rng.randint(0, 3) :]
            body = body[:10] + [w.upper() + rng.choice(["", ",", "%%%"]) for w in part] + body[10:]
        docs.append((i, " \n".join(body), "x", 0))
    docs.append(docs[-1])
    got = {(r.doc_id, r.item_id): r.agree for r in decontam.overlaps(spark.createDataFrame(docs, KIND), spark.createDataFrame(items, ITEM)).collect()}
    want = {(d[0], b[0]): s for d in docs for b in items if b[0] is not None and (s := plain(d[1], b[1])) is not None}
    assert got == want and len(want) > 30
    kept = [r.doc_id for r in decontam.clean(spark.createDataFrame(docs, KIND), spark.createDataFrame(items, ITEM)).collect()]
    bad = {d for d, _ in want}
    assert sorted(kept) == sorted(d[0] for d in docs if d[0] not in bad)


def test_without_broadcasts_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(decontam, "SEEDS", 0)
    monkeypatch.setattr(decontam, "HITS", 0)
    item = " ".join(f"q{i}" for i in range(20))
    docs = spark.createDataFrame([(None, "a " + item, "x", 0), (5, item, "x", 0), (5, "clean", "x", 0), (6, "b " * 60_000 + item, "x", 0)], KIND)
    bench = spark.createDataFrame([(1, item, 0), (1, item, 0), (2, "short one", 0)], ITEM)
    got = sorted((str(r.doc_id), r.item_id, r.place, r.agree) for r in decontam.overlaps(docs, bench).collect())
    assert got == [("5", 1, 0, 15), ("6", 1, 60_000, 15), ("None", 1, 1, 15)]
    assert [(r.doc_id, r.text, r.item_id) for r in decontam.clean(docs, bench).collect()] == [(5, "clean", "x")]
    assert decontam.overlaps(docs.limit(0), bench).collect() == [] == decontam.overlaps(docs, bench.limit(0)).collect()
