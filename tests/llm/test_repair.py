import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from driftloom.llm import repair
from driftloom.llm.queries import op13_repair

KIND = "conv_id long, turn long, role string, text string, cost int, audit string"
BLANK = " \t\n\x0b\x0c\r"


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        lot = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if lot == 4:
            role = "user"
        text = "" if lot == 1 else re.sub("[.!?]", "", text) if lot == 2 else text
        out += [(conv, turn, role, text)] * {0: 0, 3: 2}.get(lot, 1)
    return out


def faults_of(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        bare = text.rstrip(BLANK)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows, faults):
    """(cost, audit, turns) by all edit strings, kept one by one for what was said last."""
    best = {"": (0, "", ())}

    def insert(best):
        for _ in range(3):
            for last, (c, a, said) in list(best.items()):
                role = "assistant" if last == "u" else "user"
                new = (c + 5, a + "I", said + ((role, ""),))
                if role[0] not in best or new[:2] < best[role[0]][:2]:
                    best[role[0]] = new
        return best

    for (_, _, role, text), fault in zip(rows, faults):
        new = {}
        for last, (c, a, said) in insert(best).items():
            ways = [(last, c + 2, a + "D", said)]
            if fault not in ("blank", "duplicate"):
                more = 5 if fault == "truncated" else 0
                if (last, role[:1]) in (("", "s"), ("", "u"), ("s", "u"), ("a", "u"), ("u", "a")):
                    ways.append((role[0], c + more, a + "K", said + ((role, text),)))
                to = "assistant" if last == "u" else "user"
                ways.append((to[0], c + more + 1, a + "R", said + ((to, text),)))
            for state, *way in ways:
                if state not in new or tuple(way[:2]) < new[state][:2]:
                    new[state] = tuple(way)
        best = new
    return min(insert(best)[s] for s in ("", "a") if s in best)


def plain(rows):
    by = {}
    for r in rows:
        by.setdefault(r[0], [])
    for r in damaged(rows):
        by[r[0]].append(r)
    out = []
    for conv, own in by.items():
        own.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
        faults = faults_of(own)
        cost, audit, said = cheapest(own, faults)
        turns = [r[1] for r in own if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        text = "\n".join(f"{r}:{t}" for r, t in said)
        out.append((conv, gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest(), said))
    return out


def conversations(n=250, seed=3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        for t in range(rng.choice([1, 2, 5, 9, 14])):
            turn = rng.choice([t, t, t * 2, None, 3])
            rows.append((i, turn, rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "umpire"]), rng.choice(["Yes.", "Yes. ", "no", "", " \t", "é!\n", None, " ", "What?", f"{rng.random()}."])))
    return rows + [(None, 1, "user", "a."), (None, None, "assistant", "b."), (9001, 0, None, None)] + rows[:5]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 7, "x") for r in rows], KIND)


@pytest.mark.parametrize("settle", [1, 3, 1024])
def test_equals_all_edit_strings(spark, monkeypatch, settle):
    monkeypatch.setattr(repair, "SETTLE", settle)  # forked workers see it
    rows = conversations()
    turns = repair.damage(frame(spark, rows).repartition(3))
    key = lambda r: (r[0] is None, r[0] or 0)
    want = sorted(plain(rows), key=key)
    got = sorted(map(tuple, repair.audits(turns).collect()), key=key)
    assert got == [w[:9] for w in want]
    said = {}
    for r in sorted(repair.repaired(turns).collect(), key=lambda r: r.place):
        said.setdefault(r.conv_id, []).append((r.role, r.text))
    assert said == {w[0]: list(w[9]) for w in want if w[9]}
    assert all(re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in w[9])) for w in want)


def drive(rows, settle):
    audit, said = [], []

    def put(edit, role, text):
        audit.append(edit)
        said.extend([] if role is None else [(role, text)])

    before, repair.SETTLE = repair.SETTLE, settle
    try:
        one, most = repair.Repair(put), 0
        for _, turn, role, text in rows:
            one.row(turn, role, text)
            most = max(most, len(one.layers))
        return one.end(), "".join(audit), tuple(said), most
    finally:
        repair.SETTLE = before


def test_every_short_conversation():
    kinds = [("user", "q."), ("assistant", "r."), ("system", "s."), ("user", ""), ("tool", "t"), ("user", "u")]
    for n in range(5):
        for parts in itertools.product(kinds, repeat=n):
            rows = [(0, i, *p) for i, p in enumerate(parts)]
            assert drive(rows, 2)[:3] == cheapest(rows, faults_of(rows))


def test_a_long_conversation_keeps_few_layers():
    rng = random.Random(1)
    rows = [(0, i, rng.choice(["user", "assistant", "assistant", "tool"]), rng.choice(["", f"{i}.", f"{i}"])) for i in range(20_000)]
    cost, audit, said, most = drive(rows, 64)
    assert (cost, audit, said) == cheapest(rows, faults_of(rows)) and most < 200


def test_large_turns_nothing_and_rows_that_only_tell_of_a_conversation(spark, tmp_path):
    text = "z" * 2_000_000 + "."
    row = repair.audits(frame(spark, [(1, 0, "user", text), (1, 2, "assistant", text)])).first()
    assert (row.gaps, row.cost, row.audit) == (1, 0, "KK") and row.repaired_sha256 == hashlib.sha256(f"user:{text}\nassistant:{text}".encode()).hexdigest()
    none = repair.audits(frame(spark, [(1, 0, "user", "a.")]).withColumn("present", F.lit(False))).first()
    assert tuple(none) == (1, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    spark.createDataFrame([], KIND).write.parquet(f"{tmp_path}/conversations.parquet")
    assert op13_repair(spark, str(tmp_path)).collect() == []
