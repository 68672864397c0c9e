import hashlib
import random
import re

from driftloom.llm import pii
from driftloom.llm.queries import op8_pii

KIND = "doc_id long, text string, base string"
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


KINDS_ORDER = ("email", "ip", "card", "phone")


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def plain(text):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    rules = {
        "email": (EMAIL, lambda m: True),
        "ip": (IP, lambda m: all(int(x) <= 255 for x in m[0].split("."))),
        "card": (CARD, lambda m: 16 <= len(digits(m)) <= 19 and luhn(digits(m))),
        "phone": (PHONE, lambda m: 8 <= len(digits(m)) <= 15),
    }
    return {k: [(m.start(), m.end()) for m in p.finditer(text or "") if ok(m)] for k, (p, ok) in rules.items()}


def noisy(rng):
    bits = ["4532015112830366", "4532-0151-1283-0366", "4532 0151  1283 0366", "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8", "a.b@c.d.e_f@g.h", "a..b@c..d@e.f", "x@y", "+1 (988) 555-2485", "+12", "+1-2", "é😀", "@", ".", " ", "-", "%", "00255.0.0.1", "9" * 18, "\n", "word", "a@b.c.", "x-@-.-", "1-2-3-4-5-6-7-8-9-0-1-2-3-4-5-6"]
    return "".join(rng.choice(bits) + rng.choice(["", " ", ""]) for _ in range(rng.randint(0, 14)))


def test_base_equals_the_plain_patterns(spark):
    rng = random.Random(4)
    texts = [noisy(rng) for _ in range(1500)] + [None, "", "a" * 60_000, "1" * 60_000, "1 " * 30_000, "a." * 30_000 + "@b" + ".c" * 30_000, "+1" + "-" * 50_000, "4 5-" * 20_000]
    docs = spark.createDataFrame([(i, t, "b") for i, t in enumerate(texts)], KIND)
    for r in pii.find(docs).collect():
        want = plain(texts[r.doc_id])
        assert {k: [(s.start, s.end) for s in r.base[k]] for k in pii.KINDS} == want, texts[r.doc_id][:200]


def test_contexts_find_unseen_identifiers(spark):
    rows = [(i, f"words here mail: user{i}@host{i}.org thanks and more", "") for i in range(12)]
    rows += [(100, "words here mail: root@localhost thanks and more", ""), (101, "the price of 12345678 items", ""), (102, "password=b7db7aa4a5fcc78305 stays", "")]
    found = {r.doc_id: [(x.kind, x.start, x.end) for x in r.extra] for r in pii.find(spark.createDataFrame(rows, KIND)).collect()}
    assert found[100] == [("email", 17, 31)] and found[101] == found[102] == found[0] == []
    clean = {r.doc_id: r.text for r in pii.redact(spark.createDataFrame(rows, KIND)).collect()}
    assert clean[100] == "words here mail: [EMAIL] thanks and more" and clean[3] == "words here mail: [EMAIL] thanks and more"
    assert clean[101] == rows[13][1]


def test_redaction_and_odd_rows(spark):
    rows = [(1, "+1 (988) 555-2485", "x"), (1, "+1 (988) 555-2485", "x"), (1, None, "x"), (None, "é a@b.co é", None), (2, "card 4532 0151 1283 0366, ip 10.0.0.1.", "y"), (3, "plain", "z")]
    got = sorted((str(r.doc_id), str(r.text), str(r.base)) for r in pii.redact(spark.createDataFrame(rows, KIND)).collect())
    assert got == sorted([("1", "[PHONE]", "x"), ("1", "[PHONE]", "x"), ("1", "None", "x"), ("None", "é [EMAIL] é", "None"), ("2", "card [CARD], ip [IP].", "y"), ("3", "plain", "z")])
    assert pii.find(spark.createDataFrame([], KIND)).collect() == [] == pii.redact(spark.createDataFrame([], KIND)).collect()


def test_query(spark, tmp_path):
    text = "é 10.0.0.1 then a@b.co, 4532015112830366 +1 988 555 2485"
    spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in op8_pii(spark, str(tmp_path)).collect()}
    want = ",".join(f"{k}:{a}:{b}" for k, s in plain(text).items() for a, b in s)
    assert (got[1].n_email, got[1].n_ip, got[1].n_card, got[1].n_phone) == (1, 1, 1, 1)
    assert got[1].spans == want and got[1].base_sha256 == hashlib.sha256(want.encode()).hexdigest()
    assert got[2].spans == "" and got[2].base_sha256 == hashlib.sha256(b"").hexdigest()
