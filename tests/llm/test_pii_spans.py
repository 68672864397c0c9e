"""Numbers with blanks are one instance each."""

from driftloom.llm import pii

KIND = "doc_id long, text string, base string"


def found(spark, texts):
    rows = [(i, t, "") for i, t in enumerate(texts)]
    return {r.doc_id: [(x.kind, texts[r.doc_id][x.start : x.end]) for x in r.extra] for r in pii.find(spark.createDataFrame(rows, KIND)).collect()}


def test_words_before_numbers_with_blanks_are_learnt(spark):
    texts = [f"w{i} please call +1 (017) 555-{7000 + i} r{i} t" for i in range(12)]
    texts += ["we call 555-123-4567 x1 now", "we call 555 123 4567 x2 now", "we call (017) 555-7713 x3 now", "we call (017) 555-7713.", "a sum of 555 987 6543 x4"]
    got = found(spark, texts)
    assert got[12] == [("phone", "555-123-4567")] and got[13] == [("phone", "555 123 4567")]
    assert got[14] == got[15] == [("phone", "(017) 555-7713")] and got[16] == [] and all(got[i] == [] for i in range(12))
    clean = {r.doc_id: r.text for r in pii.redact(spark.createDataFrame([(i, t, "") for i, t in enumerate(texts)], KIND)).collect()}
    assert clean[14] == "we call [PHONE] x3 now" and clean[15] == "we call [PHONE]."


def test_base_spans_are_instances_with_the_words_around(spark):
    text = "é  pay  4532 0151  1283 0366 or 4532 0151 1283 0366, tel:+1 (988) 555-2485, <a@b.co> end"
    own = spark.createDataFrame([(text,)], "text string").select(pii.base_spans(pii.F.col("text"))["card"].alias("card"), "text", *[pii.base_spans(pii.F.col("text"))[k].alias(k) for k in ("email", "ip", "phone")])
    rows = own.select(pii._candidates(pii.F.col("text"), {k: pii.F.col(k) for k in pii.KINDS}).alias("c")).first().c
    seeds = {(r.kind, r.value): sorted(r.patterns) for r in rows if r.seed}
    assert seeds == {
        ("email", "a@b.co"): ["<555-2485,", "<<(988) 555-2485,", ">end"],
        ("card", "4532 0151 1283 0366"): ["<<0366 or", "<or", ">tel:+1"],
        ("phone", "+1 (988) 555-2485"): ["<0366,", "<<1283 0366,", "=tel:", "><a@b.co>"],
    }


def plain_trusted(rows, rounds=3, limit=0.8):
    """The rounds in plain Python, from (value, kind, seed, patterns)."""
    edges = {}
    for value, kind, seed, patterns in rows:
        for p in patterns:
            edges[p, value, kind] = edges.get((p, value, kind), False) or seed
    belief = {}
    for _ in range(rounds):
        trust = lambda v, k, seed: 1.0 if seed else belief.get((v, k), 0.0) * (belief.get((v, k), 0.0) >= limit)
        new = {}
        for (p, v, k), seed in edges.items():
            if seed or k == "none":
                continue
            own = [(x[2], trust(x[1], x[2], s)) for x, s in edges.items() if x[0] == p]
            mine, doubted = sum(t for kind, t in own if kind == k), sum(1 - t for kind, t in own if kind == k)
            against = sum(1 - t for kind, t in own if kind != k)
            side = new.setdefault((v, k), [0.0, 0.0])
            side[p[0] == ">"] = max(side[p[0] == ">"], mine / (mine + 0.25 * doubted + against + 1))
        belief = {x: 1 - (1 - a) * (1 - b) for x, (a, b) in new.items()}
    return {x for x, t in belief.items() if t >= limit}


def test_trust_equals_the_plain_rounds(spark):
    import random

    rng = random.Random(8)
    kinds = [*pii.ALL, "none"]
    rows = []
    for i in range(400):
        kind = rng.choice(kinds)
        context = kinds.index(kind) if rng.random() < 0.9 else rng.randrange(6)
        rows.append((f"v{i % 300}", kind, kind != "none" and rng.random() < 0.6, [f"<{context}", f">{rng.randrange(9)}", f"={context % 3}"][: rng.randint(0, 3)]))
    got = pii.trusted(spark.createDataFrame(rows, "value string, kind string, seed boolean, patterns array<string>")).collect()
    want = plain_trusted(rows)
    assert {(r.value, r.kind) for r in got} == want and len(got) == len(want) > 5


def test_what_is_planted_is_found(spark):
    """Recall and precision on identifiers that the base patterns miss, among look-alikes without such a context."""
    import random

    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 8)))
    key = lambda n, of="0123456789abcdef": "".join(rng.choice(of) for _ in range(n))
    texts, want = [], {}
    for i in range(240):
        head, tail = " ".join(word() for _ in range(8)), " ".join(word() for _ in range(8))
        seen = [f"mail: {word()}@{word()}.org", f"call +1 ({rng.randint(100, 999)}) 555-{rng.randint(1000, 9999)}", f"from host 10.{rng.randint(0, 255)}.0.{rng.randint(0, 255)}", f'token = "{key(40)}0a"'][i % 4]
        texts.append(f"{head} {seen} {tail}")
    for i in range(80):
        head, tail = " ".join(word() for _ in range(8)), " ".join(word() for _ in range(8))
        cue, kind, value = [
            ("mail:", "email", f"{word()}@localhost{i}"), ("call", "phone", f"555-{rng.randint(100, 999)}-{rng.randint(1000, 9999)}"),
            ("from host", "ip", f"fe80:{key(3)}:{key(3)}:1{key(2)}:{key(4)}"), ('token = "', "secret", f"Z9{key(14, 'GHIJKLmnop0123456789')}"),
        ][i % 4]
        want[len(texts)] = (kind, value)
        texts.append(f"{head} {cue} {value} {tail}".replace('" Z9', '"Z9'))
    for i in range(80):  # the same shapes, and numbers that are no cards, after words that say nothing
        value = [f"{word()}@home{i}", f"555-{rng.randint(100, 999)}-{rng.randint(1000, 9999)}", f"1.2.3.{300 + i}", f"x{key(14)}", f"{rng.randrange(10**15, 10**16 - 1)}"][i % 5]
        texts.append(" ".join(word() for _ in range(8)) + f" {value} " + " ".join(word() for _ in range(8)))
    got = found(spark, texts)
    right = sum((w in got[i]) for i, w in want.items())
    added = [(i, x) for i, xs in got.items() for x in xs if not (x[0] == "secret" and len(x[1]) == 42)]
    assert right == len(want) == 80 and len(added) == 80  # recall 1, precision 1
    assert sum(x[0] == "secret" and len(x[1]) == 42 for xs in got.values() for x in xs) == 60
