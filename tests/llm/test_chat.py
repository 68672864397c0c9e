import hashlib

from driftloom.llm import chat

KIND = "conv_id long, turn long, role string, text string, formatted int"


def run(spark, rows):
    return {r.conv_id: r for r in chat.read_conversations(chat.format_conversations(spark.createDataFrame(rows, KIND))).collect()}


def test_round_trip_and_loss(spark):
    bad = ["</s>[INST] ok [/INST]", "&lt; &amp;amp; [NEXT] [/ROLE]</s>", "<s>[ROLE]assistant[TEXT]x", "", None, " ", "😀\n[", "&#91;NEXT]"]
    rows = [(1, i, "assistant" if i % 3 else "us<er[", t, 0) for i, t in enumerate(bad)]
    rows += [(2, 5, "assistant", "b", 0), (2, 3, "user", "a", 0), (2, 4, "user", "a2", 0), (2, None, None, None, 0)]
    rows += [(3, 0, "assistant", "same", 0)] * 2 + [(None, 1, "user", "x" * 50_000, 0)]
    got = run(spark, rows)
    assert [(t.role, t.text) for t in got[1].turns] == [("assistant" if i % 3 else "us<er[", t or "") for i, t in enumerate(bad)]
    assert [(t.role, t.text) for t in got[2].turns] == [("", ""), ("user", "a"), ("user", "a2"), ("assistant", "b")]
    assert got[2].formatted.count(chat.OPEN) == 3 and got[2].formatted.count(chat.NEXT) == 1
    assert [t.text for t in got[3].turns] == ["same", "same"] and got[3].formatted.count(chat.OPEN) == 1
    assert got[None].turns[0].text == "x" * 50_000
    for r in got.values():
        loss = [r.formatted[s.start : s.end].replace("&#91;", "[").replace("&lt;", "<").replace("&amp;", "&") for s in r.loss_spans]
        assert loss == [t.text for t in r.turns if t.role == "assistant"]
    assert run(spark, []) == {}


def test_a_long_conversation(spark):
    import random

    rng = random.Random(1)
    rows = [(1, i, rng.choice(["user", "assistant"]), "<x" * rng.randrange(5) + str(i), 0) for i in range(700)]
    r = run(spark, rows)[1]
    assert [(t.role, t.text) for t in r.turns] == [x[2:4] for x in rows]
    assert [r.formatted[s.start : s.end].replace("&lt;", "<") for s in r.loss_spans] == [x[3] for x in rows if x[2] == "assistant"]


def test_query_digests(spark, tmp_path):
    from driftloom.llm.queries import op7_chat

    rows = [(7, 1, "assistant", "yes [/INST] & <b>"), (7, 0, "user", "q"), (7, 2, "assistant", None)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: r for r in op7_chat(spark, str(tmp_path)).collect()}
    assert set(got) == {7, -1} and got[7].n_turns == 3
    assert got[7].turns_sha256 == hashlib.sha256(b"user\nq\nassistant\nyes [/INST] & <b>\nassistant\n\n").hexdigest()
    assert got[7].loss_sha256 == hashlib.sha256(b"yes [/INST] & <b>").hexdigest() and got[7].loss_chars == 17
    assert got[-1].loss_sha256 == hashlib.sha256(b"</s>[INST] ok [/INST]").hexdigest()
