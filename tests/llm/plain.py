"""Plain versions of the pipeline's decisions, and a small corpus."""

import random

from tests.llm.test_decontam import plain as overlap
from tests.llm.test_pii import KINDS_ORDER, plain as spans
from tests.llm.test_simhash import plain as fingerprint  # noqa: F401
from tests.llm.test_simhash import reach  # noqa: F401


def corpus():
    rng = random.Random(12)
    vocab = {"aa": ["the", "and", "house", "river", "stone", "walks", "under"], "bb": ["der", "und", "haus", "fluss", "stein", "geht", "unter"]}
    say = lambda lang, n: " ".join(rng.choice(vocab[lang]) + rng.choice(["", "", "er", "ing"]) for _ in range(n))
    bench = [(i, " ".join(f"item{i}word{j}" for j in range(22))) for i in range(3)]
    rows = []
    for i in range(120):
        lang = rng.choice(["aa", "bb"])
        text = say(lang, rng.randint(20, 90))
        if i % 10 == 3:
            text += " " + bench[i % 3][1].upper() + " " + say(lang, 5)
        if i % 10 == 4:
            text += f" write to user{i}@mail.example.org or +1 988 555 {2000 + i}, from 10.0.0.{i}"
        if i % 10 == 5 and rows:
            text, lang = rows[rng.randrange(len(rows))][1:3]
        rows.append((i, text, lang if i % 7 else None, rng.choice(["s1", "s2", "s3", None]), 0))
    rows += [(500, None, "aa", "s1", 0), (501, "", "aa", "s1", 0), (502, "1 2 3", "aa", "s2", 0)]
    return [(i, t, g, s, len(t or "")) for i, t, g, s, _ in rows], bench


def contaminated(text, item):
    return overlap(text, item) is not None


def redacted(text):
    found = sorted((a, b, k) for k in KINDS_ORDER for a, b in spans(text)[k])
    at, out = 0, ""
    for a, b, k in found:
        if a >= at:
            out += text[at:a] + f"[{k.upper()}]"
        at = max(at, b)
    return out + text[at:]
