import math
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from driftloom.llm import mixing

KIND = "doc_id long, source string, text string, size string"


def water(sizes, weights=(1, 2, 3), most=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, goal, open_ = sum(sizes.values()), {}, set(names)
    while open_:
        spare = total - sum(goal.values())
        share = {s: spare * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > most * sizes[s]}
        if not over:
            return goal | share
        goal |= {s: most * sizes[s] for s in over}
        open_ -= over
    return goal


def rows(spark):
    data = [(i, ["b", "a", "C", None, "z"][0 if i % 3 == 0 else i % 5], "w " * (i * i % 97), "x") for i in range(1500)]
    data += [(None, "b", "one two"), (None, "b", "three"), (5, "b", None), (6, "b", " \t"), (7, "tiny", "a"), (8, "none", ""), (9, "a", "word x " * 3000), (10, "b", "same row"), (10, "b", "same row")]
    return [(*r, "y")[:4] for r in data]


def words_of(text):
    return len((text or "").split())


def pmf(k, total, marked, drawn):
    if k < max(0, drawn - (total - marked)) or k > min(drawn, marked):
        return 0.0
    return math.comb(marked, k) * math.comb(total - marked, drawn - k) / math.comb(total, drawn)


def invert(u, total, marked, drawn):
    upto = 0.0
    for k in range(min(drawn, marked) + 1):
        upto += pmf(k, total, marked, drawn)
        if u < upto:
            return k
    return min(drawn, marked)


def test_targets_and_taken(spark):
    data = rows(spark)
    docs = spark.createDataFrame(data, KIND)
    got = mixing.mix(docs).collect()
    assert len(got) == len(data)
    sizes = defaultdict(int)
    for _, s, t, _ in data:
        sizes[s] += words_of(t)
    goal = water(sizes)
    taken, copies = defaultdict(int), Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - goal[r.source]) < 1e-6 * (1 + goal[r.source])
        assert 0 <= r.taken <= 3 * r.size and r.taken == sum(d.words for d in r.draws)
        taken[r.source] += r.taken
        copies[len(r.draws)] += 1
    for s in sizes:
        assert taken[s] == round(goal[s])
    cut = [r for r in got if r.size and r.taken % r.size]
    assert len(cut) <= len(sizes) and min(copies) == 0
    again = mixing.mix(docs.repartition(7)).collect()
    key = lambda r: (str(r.doc_id), r.size, str(r.draws))
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_draws_equal_the_plain_version(spark, monkeypatch):
    """Quotas, tree, stretches, permutations and sums once more in plain Python; only hashes come from Spark."""
    monkeypatch.setattr(mixing, "LEAST_BLOCKS", 40)
    data, seed, shards = rows(spark), 9, 8
    docs = spark.createDataFrame(data, KIND)
    h = lambda k, *c: F.xxhash64(F.lit(k), *c)
    told = docs.select("doc_id", "source", "text", h(seed, "doc_id", "text").alias("mark"), h(seed + 2, "doc_id", h(seed, "doc_id", "text")).alias("line")).collect()
    blocks, members, total = defaultdict(int), defaultdict(list), defaultdict(int)
    for r in told:
        n = words_of(r.text)
        blocks[r.source, r.mark % 40] += n
        members[r.source, r.mark % 40].append((r.line, r.doc_id is not None, r.doc_id or 0, n))
        total[r.source] += n
    order = {(r.s, r.b): r.h for r in spark.createDataFrame(list(blocks), "s string, b long").select("s", "b", h(seed + 1, "s", "b").alias("h")).collect()}
    goal = {s: round(g) for s, g in water(total).items()}
    quota, passes, rest, some, lines = {}, {}, {}, {}, {}
    for s in total:
        lines[s] = sorted((b for b in blocks if b[0] == s and blocks[b]), key=lambda b: (order[b], b[1]))
        passes[s] = goal[s] // max(total[s], 1)
        rest[s] = goal[s] - passes[s] * total[s]
        some[s] = math.ceil(rest[s] * len(lines[s]) / total[s]) if total[s] else 0
        quota[s] = passes[s] * len(lines[s]) + some[s]
    names = sorted(total, key=lambda s: (s is not None, (s or "").encode()))
    lots = {(r.n, r.s): r.u for r in spark.createDataFrame([(n, s) for n in range(1, shards) for s in names], "n long, s string").select("n", "s", (F.pmod(h(seed, "n", "s"), F.lit(1 << 52)) / float(1 << 52)).alias("u")).collect()}
    nodes = {1: dict(quota)}
    for node in range(1, shards):
        left, open_, remains = {}, (sum(nodes[node].values()) + 1) // 2, sum(nodes[node].values())
        for s in names:
            left[s] = invert(lots[node, s], remains, nodes[node][s], open_)
            open_, remains = open_ - left[s], remains - nodes[node][s]
        nodes[2 * node], nodes[2 * node + 1] = left, {s: nodes[node][s] - left[s] for s in names}
    want = Counter()
    for s in names:
        leaves = [nodes[shards + j][s] for j in range(shards)]
        sequence = [j for j in range(shards) for _ in range(leaves[j])]
        n = len(lines[s])
        for d, j in enumerate(sequence[: passes[s] * n]):
            for m in members[lines[s][d % n]]:
                want[s, m[2] if m[1] else None, m[3], j, m[3]] += m[3] > 0
        drawn = {}
        for d, j in enumerate(sequence[passes[s] * n :]):
            drawn[d + (n - some[s]) * j // shards] = j
        idle = [r for r in range(n) if r not in drawn]
        left = rest[s]
        for r in [*sorted(drawn), *idle]:
            use = min(left, blocks[lines[s][r]])
            left -= use
            if use == blocks[lines[s][r]]:
                for m in members[lines[s][r]]:
                    want[s, m[2] if m[1] else None, m[3], drawn.get(r, sequence[-1] if sequence else 0), m[3]] += m[3] > 0
            elif use:
                for m in sorted(members[lines[s][r]]):
                    want[s, m[2] if m[1] else None, m[3], drawn.get(r, sequence[-1] if sequence else 0), min(use, m[3])] += min(use, m[3]) > 0
                    use -= min(use, m[3])
    got = Counter((r.source, r.doc_id, r.size, d.shard, d.words) for r in mixing.mix(docs).collect() for d in r.draws)
    assert got == +want


def test_the_tree_decides_what_is_drawn(spark, monkeypatch):
    docs = spark.createDataFrame(rows(spark), KIND)
    key = lambda rs: sorted((str(r.doc_id), r.size, r.taken) for r in rs)
    mine = key(mixing.mix(docs).collect())
    monkeypatch.setattr(mixing, "hypergeometric", lambda u, total, marked, drawn: F.least(marked, drawn))
    assert key(mixing.mix(docs).collect()) != mine


def test_draws_are_hypergeometric(spark):
    us = [i / 2000 + 1 / 4000 for i in range(2000)]
    for total, marked, drawn in ((30, 12, 15), (9, 9, 4), (9, 0, 4), (0, 0, 0), (40_000, 9_000, 20_000), (5, 3, 5)):
        frame = spark.createDataFrame([(u, total, marked, drawn) for u in us], "u double, t long, m long, d long")
        got = [r.k for r in frame.select(mixing.hypergeometric(*[F.col(c) for c in "utmd"]).alias("k")).collect()]
        mean = drawn * marked / total if total else 0
        var = mean * (1 - marked / total) * (total - drawn) / (total - 1) if total > 1 else 0
        own = sum(got) / len(got)
        assert abs(own - mean) < 0.02 + 0.01 * var**0.5 and abs(sum((k - own) ** 2 for k in got) / len(got) - var) < 0.02 + 0.02 * var
        if total < 100:
            assert got == [invert(u, total, marked, drawn) for u in us]


def test_split_is_exact_and_even(spark):
    quotas = {"a": 300, "b": 5, None: 120, "c": 0}
    many = Counter()
    for seed in range(40):
        got = mixing.split(spark.createDataFrame(list(quotas.items()), "source string, quota long").coalesce(1), 4, seed).collect()
        by, shard = Counter(), Counter()
        for r in got:
            assert r.quota >= 0
            by[r.source] += r.quota
            shard[r.shard] += r.quota
            if r.source == "a":
                many[r.shard] += r.quota
        assert all(by[s] == q for s, q in quotas.items())
        assert max(shard.values()) - min(shard.values()) <= 2
    # The mean of a shard's share is a quarter of 300; 40 draws have a deviation of 4.6 / 6.3.
    assert all(abs(many[j] / 40 - 75) < 4 for j in range(4)) and len(set(many.values())) > 1


def test_documents_keep_all_columns(spark):
    data = [(i, "s", "some words here", "x", 1.5) for i in range(50)] + [(1, "s", "some words here", "x", 1.5), (60, None, None, None, None)]
    docs = spark.createDataFrame(data, "doc_id long, source string, text string, taken string, `Size.x` double")
    got = mixing.drawn(docs)
    assert got.columns == ["doc_id", "source", "text", "taken", "Size.x", "size", "source_size", "target", "taken_mix", "draws"]
    found = got.collect()
    assert sum(r.taken_mix for r in found) == 153 and all(r["Size.x"] == 1.5 and r.text for r in found)


def test_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, source string, text string")
    assert mixing.mix(none).collect() == [] == mixing.drawn(none).collect()
    blank = spark.createDataFrame([(1, "a", None), (2, None, " ")], "doc_id long, source string, text string")
    assert [(r.size, r.taken, r.draws) for r in mixing.mix(blank).collect()] == [(0, 0, []), (0, 0, [])]
