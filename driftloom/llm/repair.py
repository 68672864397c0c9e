"""Cheapest repair of damaged conversations.

A repaired conversation has the roles ``(s?(ua)+)?``.  Rows are layers of a
dynamic program over what has been said last: nothing, a system, a user or an
assistant turn.  An edit of a layer is a run of inserts and then what is done
with the row (``D``, ``K`` or ``R``), so that its spelling is one of a few
prefix-free codes, numbered in ASCII order.  As all paths to a layer have as
many codes, comparing two of them as strings is comparing the ranks of their
parents and then their own codes: each state of a layer keeps a cost, a rank
and a pointer to its parent, and no string.  Audit and text are spelt out from
the pointers, as soon as all states that can still win have one ancestor.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns_apart

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: States by the initial of what was said last, and their final inserts.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
TAILS = ("", "II", "I", "")
#: Inserts in a run before a row: a longer one comes back to a state that it has been in.
RUN = 2
CODES = sorted("I" * n + x for n in range(RUN + 1) for x in "DKR")
#: A state that costs so much more than another can't win: it can do what that one does for two inserts at most.
MARGIN = 2 * INSERT
#: Layers after which what is settled is written out.
SETTLE = 1024
BLANKS = " \t\n\x0b\x0c\r"
FAULTS = ("blank", "duplicate", "truncated")
NEVER = 1 << 60


def _said(state: int) -> int:
    """The state after a user or assistant turn that may follow."""
    return ASSISTANT if state == USER else USER


def _moves(initial: str, stays: bool) -> list[tuple[int, int, int, int, bool]]:
    """(from, to, code, cost, whether the row stays) of all edits of a row."""
    found = []
    for start in range(4):
        for code, spelt in enumerate(CODES):
            state, cost, what = start, INSERT * (len(spelt) - 1), spelt[-1]
            for _ in spelt[:-1]:
                state = _said(state)
            if what == "D":
                found.append((start, state, code, cost + DELETE, False))
            elif stays and what == "R":
                found.append((start, _said(state), code, cost + REROLE, True))
            elif stays and initial == "s" and state == NOTHING:
                found.append((start, SYSTEM, code, cost + KEEP, True))
            elif stays and initial == ("a" if state == USER else "u"):
                found.append((start, _said(state), code, cost + KEEP, True))
    return found


_MOVES = {(i, stays): _moves(i, stays) for i in ("s", "u", "a", "") for stays in (False, True)}


class Repair:
    """The state of one conversation while its rows pass in order.

    ``put`` is given each edit when it is settled: its initial, and the role
    and text that the repaired conversation gets by it (null where deleted).
    """

    def __init__(self, put: Callable[[str, str | None, str | None], None]):
        self.put = put
        self.cost, self.rank = [0, NEVER, NEVER, NEVER], [0, 0, 0, 0]
        self.layers: list[tuple] = []  # pointers of the four states, and the row
        self.counts = dict.fromkeys(("gaps", *FAULTS, "illegal"), 0)
        self.seen: set[bytes] = set()
        self.before: str | None = None
        self.turns: list[int] | None = None  # first, last, distinct
        self.last = NOTHING

    def row(self, turn: int | None, role: str, text: str) -> None:
        if turn is not None:
            first, last, distinct = self.turns or (turn, turn, 1)
            self.turns = [first, turn, distinct + (turn != last)]
        initial = role[:1]
        if self.before is not None and self.before + initial not in ("su", "ua", "au"):
            self.counts["illegal"] += 1
        self.before = initial
        bare = text.rstrip(BLANKS)
        digest = hashlib.blake2b(f"{len(role)}:{role}{text}".encode("utf-8", "surrogatepass"), digest_size=16).digest()
        fault = "blank" if not bare else "duplicate" if digest in self.seen else "truncated" if bare[-1] not in ".!?" else None
        self.seen.add(digest)
        if fault:
            self.counts[fault] += 1
        stays = fault not in ("blank", "duplicate")
        self._layer(initial, stays, TRUNCATED if fault == "truncated" else 0, (role, text) if stays else ("", ""))

    def _layer(self, initial: str, stays: bool, extra: int, row: tuple[str, str]) -> None:
        cost, rank = self.cost, self.rank
        best: list[tuple | None] = [None] * 4
        for start, to, code, price, held in _MOVES[initial if initial in ("s", "u", "a") else "", stays]:
            if cost[start] < NEVER:
                key = (cost[start] + price + (extra if held else 0), rank[start], code, start)
                if best[to] is None or key < best[to]:
                    best[to] = key
        least = min(b[0] for b in best if b)
        alive = [s for s in range(4) if best[s] and best[s][0] <= least + MARGIN]
        order = sorted(alive, key=lambda s: best[s][1:3])
        self.cost = [best[s][0] if s in alive else NEVER for s in range(4)]
        self.rank = [order.index(s) if s in alive else 0 for s in range(4)]
        self.layers.append(([best[s][3] if s in alive else -1 for s in range(4)], [best[s][2] if s in alive else -1 for s in range(4)], row))
        if len(self.layers) % SETTLE == 0:
            self._settle(alive)

    def _settle(self, alive: list[int]) -> None:
        """Spell out all layers up to the last in which the living states have one ancestor."""
        at, states = len(self.layers), set(alive)
        while at and len(states) > 1:
            at -= 1
            states = {self.layers[at][0][s] for s in states}
        if at:
            self._spell(self.layers[:at], states.pop())
            del self.layers[:at]

    def _spell(self, layers: list[tuple], state: int) -> None:
        codes = []
        for parents, own, _ in reversed(layers):
            codes.append(own[state])
            state = parents[state]
        for (_, _, (role, text)), code in zip(layers, reversed(codes)):
            *inserts, what = CODES[code]
            for _ in inserts:
                self._say("I", None, "")
            if what == "D":
                self.put("D", None, None)
            else:
                self._say(what, role if what == "K" else None, text)

    def _say(self, edit: str, role: str | None, text: str) -> None:
        """A turn of a given role, or of the one that must follow."""
        self.last = SYSTEM if role is not None and role[:1] == "s" else _said(self.last)
        self.put(edit, role if role is not None else "assistant" if self.last == ASSISTANT else "user", text)

    def end(self) -> int:
        """Settle the rest; the cost."""
        total, _, tail, state = min((self.cost[s] + INSERT * len(TAILS[s]), self.rank[s], TAILS[s], s) for s in range(4) if self.cost[s] < NEVER)
        self._spell(self.layers, state)
        self.layers = []
        for _ in tail:
            self._say("I", None, "")
        if self.turns:
            self.counts["gaps"] = self.turns[1] - self.turns[0] + 1 - self.turns[2]
        return total


def damage(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, present of ``turns`` after damage by crc32(``conv_id:turn``) % 20.

    0 drops a row (it stays with ``present`` false, so that its conversation is
    not forgotten), 1 empties its text, 2 takes ``.!?`` from it, 3 repeats it,
    4 makes it a user's.  A null role or text, and a null id or turn in what is
    hashed, is one space.
    """
    own = columns_apart(turns, "conv_id", "turn", "role", "text")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    lot = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn"))) % 20
    own = own.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), lot.alias("lot"))
    hurt = own.select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        F.when(F.col("lot") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("lot") <= 1, "").when(F.col("lot") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        (F.col("lot") != 0).alias("present"),
        F.when(F.col("lot") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))).alias("copies"),
    )
    return hurt.withColumn("copy", F.explode("copies")).drop("copies", "copy")


def _in_order(turns: DataFrame) -> DataFrame:
    """Rows of a conversation together and in order: by turn (null first), then role and text."""
    own = columns_apart(turns, "conv_id", "turn", "role", "text", *(["present"] if "present" in turns.columns else []))
    if "present" not in turns.columns:
        own = own.withColumn("present", F.lit(True))
    own = own.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), "present")
    return own.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def _conversations(batches: Iterator, begin: Callable, finish: Callable) -> Iterator:
    """Passes each row to the Repair of its conversation; yields what ``finish`` makes of each that ends."""
    now, on = None, False
    for batch in batches:
        for conv, turn, role, text, present in zip(*(c.to_pylist() for c in batch.columns)):
            if not on or conv != now:
                if on:
                    yield finish(now, repair)
                now, on, repair = conv, True, begin(conv)
            if present:
                repair.row(turn, role, text)
    if on:
        yield finish(now, repair)


def audits(turns: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of each conversation.

    ``turns`` has conv_id, turn, role, text and perhaps present, false in rows
    that only tell that a conversation exists.  Rows are taken by turn, null
    first, those of one turn by role and text; repeated rows are rows of their
    own; a null role or text is one space, and an empty text is blank.  Rows
    with a null conv_id form one conversation.  A conversation without a
    present row has zeros and an empty audit.  No rows give none.  Other
    columns are ignored, whatever their names.

    A conversation is one task's, as its audit and digest are: of a long one
    the task holds the audit, a digest of each row, and the texts that no
    settled edit has yet.
    """

    def work(batches: Iterator):
        import pyarrow as pa

        def begin(conv):
            audit, digest = [], hashlib.sha256()

            def put(edit, role, text):
                if role is not None:
                    digest.update((("\n" if put.any else "") + f"{role}:{text}").encode("utf-8", "surrogatepass"))
                    put.any = True
                audit.append(edit)

            put.any = False
            repair = Repair(put)
            repair.told = (audit, digest)
            return repair

        def finish(conv, repair):
            cost = repair.end()
            audit, digest = repair.told
            return (conv, *repair.counts.values(), cost, "".join(audit), digest.hexdigest())

        yield from _batches(pa, _conversations(batches, begin, finish), schema)

    ordered = _in_order(turns)
    kind = ordered.schema["conv_id"].dataType.simpleString()
    schema = [("conv_id", kind), *((c, "long") for c in ("gaps", *FAULTS, "illegal", "cost")), ("audit", "string"), ("repaired_sha256", "string")]
    return ordered.mapInArrow(work, ", ".join(f"{n} {t}" for n, t in schema))


def repaired(turns: DataFrame) -> DataFrame:
    """conv_id, place (from 1), edit, role, text: the turns of the repaired conversations, and by which edit each is there.

    Takes what ``audits`` takes, by the same rules; deleted rows have no turn.
    """

    def work(batches: Iterator):
        import pyarrow as pa

        def rows():
            out: list[tuple] = []

            def begin(conv):
                def put(edit, role, text):
                    if role is not None:
                        put.at += 1
                        out.append((conv, put.at, edit, role, text))

                put.at = 0
                return Repair(put)

            for _ in _conversations(batches, begin, lambda conv, repair: repair.end()):
                yield from out
                out.clear()

        yield from _batches(pa, rows(), schema)

    ordered = _in_order(turns)
    kind = ordered.schema["conv_id"].dataType.simpleString()
    schema = [("conv_id", kind), ("place", "long"), ("edit", "string"), ("role", "string"), ("text", "string")]
    return ordered.mapInArrow(work, ", ".join(f"{n} {t}" for n, t in schema))


def _batches(pa, rows: Iterator[tuple], schema: list[tuple[str, str]], size: int = 2000) -> Iterator:
    types = {"long": pa.int64(), "bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}  # others as Arrow sees them
    held = []

    def done():
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in held], types.get(t)) for i, (_, t) in enumerate(schema)], [n for n, _ in schema])

    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield done()
            held.clear()
    yield done()
