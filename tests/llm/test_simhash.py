import re

import xxhash

from driftloom.llm import simhash

KIND = "doc_id long, text string"


def plain(text, words=3):
    found = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not found:
        return 0
    shingles = [" ".join(found[i : i + words]) for i in range(len(found) - words + 1)] or [" ".join(found)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def reach(prints, distance=2):
    root = {i: i for i in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in prints:
        for b in prints:
            if a < b and bin(prints[a] ^ prints[b]).count("1") <= distance:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in prints}


def test_fingerprints_equal_the_plain_statement():
    texts = ["", None, " \t\n", "One", "one two", "A b C d e f", "é É ß  x\x0by\x1cz", "word " * 500, "x y z " * 9000]
    assert simhash.fingerprints_of(texts) == [plain(t) for t in texts]


def test_components_equal_brute_force(spark):
    base = " ".join(f"w{i}" for i in range(400))
    texts = {0: base, 1: base, 9: base.upper(), 2: base + " tail", 3: None, 4: "", 5: "solo", 6: base.replace("w7 ", "q "), 7: "other " * 30 + "end", 8: base + " a b"}
    docs = spark.createDataFrame([(i, t, "x") for i, t in texts.items()], KIND + ", fp string")
    got = {r.doc_id: (r.fp & (2**64 - 1), r.component_id) for r in simhash.near_duplicates(docs).collect()}
    prints = {i: plain(t) for i, t in texts.items()}
    want = reach(prints)
    assert got == {i: (prints[i], want[i]) for i in texts}
    kept = {r.doc_id for r in simhash.keep_one(docs).collect()}
    assert kept == {i for i in texts if want[i] == i}


def test_links_find_every_pair_within_two_bits(spark):
    import random

    rng = random.Random(5)
    seeds = [rng.getrandbits(64) for _ in range(12)]
    values = {s ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3))) for s in seeds for _ in range(12)}
    prints = dict(enumerate(sorted(values)))
    signed = {i: v - (1 << 64) if v >> 63 else v for i, v in prints.items()}
    rows = spark.createDataFrame([(v,) for v in signed.values()], "fp long").cache()
    near = lambda a, b: bin((a ^ b) & (2**64 - 1)).count("1")
    # Segment tables alone, crowded values alone, both; balls of radius 0, 1 and 2.
    for distance, count, hot in ((1, 2, 64), (2, 2, 64), (2, 2, 0), (2, 2, 5), (3, 2, 64), (3, 2, 0), (3, 4, 64), (4, 2, 64)):
        edges = simhash.links(rows, distance, count, hot)
        assert all(near(r.a, r.b) <= distance for r in edges.collect())
        got = {r.node: r.root for r in simhash.components(edges).collect()}
        want = reach(prints, distance)
        groups = {}
        for i, r in want.items():
            groups.setdefault(r, set()).add(signed[i])
        for g in groups.values():
            assert len({got.get(v, v) for v in g}) == 1
        assert len({got.get(v, v) for v in signed.values()}) == len(groups)


def test_pairs_are_met_in_segment_tables(spark):
    far, near = 0b111 | 0b1 << 40, 0b1 | 0b1 << 40
    rows = spark.createDataFrame([(0,), (far,), (near,)], "fp long")
    assert sorted((r.a, r.b) for r in simhash.links(rows, 2).collect()) == [(near, 0), (far, near)]
    told = rows.select("fp", simhash.segments(simhash.F.col("fp"), 2).alias("s")).collect()
    assert {r.fp: [x.value for x in r.s] for r in told} == {0: [0, 0], far: [7, 256], near: [1, 256]}
    assert len(simhash.masks(32, 1)) == 33 and len(simhash.masks(64, 2)) == 2081


def test_columns_with_odd_names_stay(spark):
    docs = spark.createDataFrame([(1, "a b c", 1), (2, "A b c", 2)], "doc_id long, text string, `x.y` int")
    assert [tuple(r) for r in simhash.keep_one(docs).collect()] == [(1, "a b c", 1)]


def test_no_rows_and_null_ids(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], KIND)).collect() == []
    docs = spark.createDataFrame([(None, "a b c d"), (3, "a b c d"), (3, "a b c d"), (None, "zz")], KIND)
    assert sorted((str(r.doc_id), str(r.component_id)) for r in simhash.near_duplicates(docs).collect()) == [("3", "3"), ("3", "3"), ("None", "3"), ("None", "None")]
    assert simhash.keep_one(docs).count() == 4
