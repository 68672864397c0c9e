import hashlib
import random

import numpy as np
import pytest

from driftloom.llm import suffix

KIND = "doc_id long, text string, blob int"


def plain(rows, least=50):
    """What each row loses, by looking all strings up."""
    order = lambda d: suffix.NOBODY if d is None else d
    first = {}
    for d, t in rows:
        raw = (t or "").encode()
        for i in range(len(raw) - least + 1):
            s = raw[i : i + least]
            first[s] = min(first.get(s, suffix.NOBODY), order(d))
    out = []
    for d, t in rows:
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - least + 1):
            if first[raw[i : i + least]] < order(d):
                gone[i : i + least] = b"\1" * least
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((d, len(raw), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(raw, gone) if not g)).hexdigest()))
    return sorted(map(repr, out))


def corpus(seed, n=140):
    rng = random.Random(seed)
    words = ["é", "the", "of", "tion", "ing", "ab", "😀", "x" * 9, "river"]
    say = lambda k: " ".join(rng.choice(words) + str(rng.randint(0, 40)) for _ in range(k))
    shared = [say(rng.randint(5, 40)) for _ in range(6)]
    rows = []
    for i in range(n):
        t = say(rng.randint(0, 60))
        kind = i % 6
        if kind == 1:
            t += rng.choice(shared) + say(4)
        elif kind == 2 and rows:
            old = rng.choice(rows)[1] or ""
            at = rng.randint(0, len(old))
            t = old[:at] + rng.choice(["", "Q", say(2)]) + old[at + rng.randint(0, 3) :]
        elif kind == 3 and rows:
            t = rng.choice(rows)[1]
        elif kind == 4:
            t = rng.choice(["a", "ab", "abc "]) * rng.randint(10, 90)
        rows.append((rng.randint(0, 10**6) if i % 20 else None, t))
    return [*rows, rows[3], (rows[5][0], "other text"), (7, None), (8, "")]


def test_intervals_equal_sorted_suffixes():
    rng = np.random.default_rng(3)
    text = np.concatenate([np.frombuffer(b"abracadabra" * 9, np.uint8), rng.integers(97, 99, 300).astype(np.uint8), [255]]).astype(np.uint8)
    for least in (32, 50):
        order, apart = suffix.intervals(text, least)
        double = bytes(text) + bytes(64)
        cut = [double[i : i + least] for i in order]
        cyclic = bytes(text) * 2
        for i in range(1, len(order)):
            if order[i] + least <= len(text) and order[i - 1] + least <= len(text):
                assert apart[i] == (cut[i] != cut[i - 1])
        assert sorted(order) == list(range(len(text))) and cyclic


def test_owners_are_the_smallest_documents():
    a = bytes(range(65, 65 + 26)) * 3
    contents = [a[:70], a[5:70] + b"zz", b"q" * 55]
    got = suffix.owners(contents, [9, 4, 5])
    first = {}
    for c, d in zip(contents, [9, 4, 5]):
        for i in range(len(c) - 49):
            first[c[i : i + 50]] = min(first.get(c[i : i + 50], 99), d)
    assert list(got) == [first[c[i : i + 50]] for c in contents for i in range(len(c) - 49)]


@pytest.mark.parametrize("chunk", [1 << 19, 700])
def test_equals_brute_force(spark, monkeypatch, chunk):
    rows = corpus(1)
    monkeypatch.setattr(suffix, "GROUP", 3000)
    monkeypatch.setattr(suffix, "PER_ANCHORS", 9000)
    monkeypatch.setattr(suffix, "PER_CONTENTS", 5000)
    monkeypatch.setattr(suffix, "TEXT", 2000)
    if chunk == 700:
        return check_steps(rows, chunk, monkeypatch)
    docs = spark.createDataFrame([(d, t, 0) for d, t in rows], KIND).repartition(3)
    got = sorted(repr((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)) for r in suffix.deduplicate(docs).collect())
    assert got == plain(rows)
    assert any(" 0, 0," not in g for g in got)


def check_steps(rows, chunk, monkeypatch):
    """The steps without Spark, with texts cut to small chunks."""
    import pyarrow as pa

    monkeypatch.setattr(suffix, "CHUNK", chunk)
    key = lambda k: (pa.scalar(k),)
    groups = {}
    for d, t in rows:
        groups.setdefault((d or 0) % 5, []).append((d, (t or "").encode()))
    tables = {r: pa.table({"doc_id": pa.array([d for d, _ in g], pa.int64()), "text": pa.array([t for _, t in g], pa.binary())}) for r, g in groups.items()}

    def dealt(rows, by):
        out = {}
        for r in rows:
            out.setdefault(r[by], []).append(r)
        return {k: pa.Table.from_pylist(v) for k, v in out.items()}

    flat = lambda done: [r for t in done for r in t.to_pylist()]
    empty = pa.table({"r": pa.array([], pa.int64()), "p": pa.array([], pa.int64()), "q": pa.array([], pa.int64()), "blob": pa.array([], pa.binary())})
    listed = dealt(flat(suffix.listing(3, 50)(key(r), t) for r, t in tables.items()), "p")
    masks = dealt(flat(suffix.shared()(key(p), t) for p, t in listed.items()), "r")
    sent = dealt(flat(suffix.sending(3, 4, 50)(key(r), t, masks.get(r, empty)) for r, t in tables.items()), "q")
    told = dealt(flat(suffix.owning(50)(key(q), t) for q, t in sent.items()), "r")
    done = flat(suffix.removing(50, True)(key(r), t, told.get(r, empty)) for r, t in tables.items())
    assert sorted(repr((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"])) for r in done) == plain(rows)
    assert all(hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"] for r in done)


def test_long_texts_and_nothing(spark):
    rng = random.Random(2)
    long = "".join(rng.choice("abcdefgh ") for _ in range(1_300_000))
    rows = [(1, long), (2, "tail " + long[600_000:600_060]), (3, "a" * 1_000_000), (4, "b" + "a" * 60)]
    got = {r.doc_id: r for r in suffix.deduplicate(spark.createDataFrame([(d, t, 0) for d, t in rows], KIND)).collect()}
    assert (got[1].n_removed, got[2].n_removed, got[2].n_spans, got[3].n_removed, got[4].n_removed) == (0, 60, 1, 0, 60)
    assert suffix.deduplicate(spark.createDataFrame([], KIND)).collect() == []
