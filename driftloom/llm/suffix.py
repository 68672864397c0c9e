"""Removal of byte strings that an earlier document has, by a Burrows-Wheeler transform.

Every string of ``least`` bytes is dealt by its smallest hashed 24-gram, its
anchor, so equal strings meet.  A run of strings in a row with one anchor is
one content.  In order:

1. Groups of documents list the anchors they have; an anchor that is nowhere
   else can hold no match and goes.
2. Groups send each content of the other anchors once, with the smallest
   doc_id that has it; copies inside a group cost nothing more.
3. Contents of one anchor are joined to a text.  On its Burrows-Wheeler
   transform, breadth-first backward extension derives where neighbouring
   suffixes differ within 1, 2, 3 bytes and so on, and stops at ``least``:
   what is not apart then is an interval of equal strings, whose smallest
   doc_id is the owner.
4. Groups look up the owners of their contents and remove what they don't own.

Documents are shuffled once, and read by the three steps from that exchange.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns_apart

#: Shortest match, bytes of an anchor.
LEAST, GRAM = 50, 24
#: Bytes of text in a group of documents, worked on at once, and of contents in one transform.
GROUP, CHUNK, TEXT = 2 << 20, 1 << 19, 1 << 16
#: Bytes of text for one bucket of anchors and one of contents.
PER_ANCHORS, PER_CONTENTS = 8 << 20, 4 << 20
MASK = (1 << 20) - 1
#: Owner of what no document with an id has.
NOBODY = (1 << 63) - 1

_POWERS: list = []


def _powers(n: int):
    """Powers of an odd base and of its inverse, modulo 2^64."""
    import numpy as np

    if not _POWERS or len(_POWERS[0]) < n:
        base = 0x9E3779B97F4A7C15
        inverse = pow(base, -1, 1 << 64)
        _POWERS[:] = [np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(max(n, CHUNK + 64), x, np.uint64)))) for x in (base, inverse)]
    return _POWERS


def _mixed(x):
    import numpy as np

    x = x ^ (x >> np.uint64(31))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def chunks(texts: list[bytes], least: int = LEAST):
    """(bytes, starts, ends, document, offset in it) of texts joined to chunks; a long text is cut so that no string is lost."""
    import numpy as np

    room = max(CHUNK, 4 * least)
    parts, size = [], 0

    def joined():
        ends = np.cumsum([len(p[0]) for p in parts])
        return np.frombuffer(b"".join(p[0] for p in parts), np.uint8), np.concatenate(([0], ends[:-1])), ends, np.array([p[1] for p in parts]), np.array([p[2] for p in parts])

    for k, text in enumerate(texts):
        if len(text) < least:
            continue
        for at in range(0, len(text) - least + 1, room - least + 1):
            part = text[at : at + room]
            if size + len(part) > room and parts:
                yield joined()
                parts, size = [], 0
            parts.append((part, k, at))
            size += len(part)
    if parts:
        yield joined()


def runs(data, starts, ends, least: int = LEAST):
    """start, strings, anchor hash and content hash of each run, and which part it is in."""
    import numpy as np

    n = len(data)
    power, inverse = _powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:n], out=sums[1:])
    gram = _mixed((sums[GRAM:] - sums[:-GRAM]) * inverse[: n - GRAM + 1])
    low = (gram & np.uint64(~MASK & (1 << 64) - 1)) | np.arange(len(gram), dtype=np.uint64)
    width, have = least - GRAM + 1, 1
    while 2 * have <= width:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    if have < width:
        low = np.minimum(low[: have - width], low[width - have :])
    anchor = (low & np.uint64(MASK)).astype(np.int64)
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, np.maximum(starts, ends - least + 1), 1)
    np.add.at(edge, ends, -1)
    inside = np.flatnonzero(np.cumsum(edge)[: len(anchor)] == 0)
    at = anchor[inside]
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    start, count = inside[first], np.diff(np.concatenate((first, [len(inside)])))
    content = _mixed((sums[start + count + least - 1] - sums[start]) * inverse[start] + count.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return start, count, gram[at[first]], content, np.searchsorted(ends, start, "right")


def _group(table):
    """Texts and doc_ids of a group; a null id is NOBODY."""
    docs = [NOBODY if d is None else d for d in table.column("doc_id").to_pylist()]
    return [t or b"" for t in table.column("text").to_pylist()], docs


def _packed(keys) -> bytes:
    """Sorted 32-bit numbers as compressed differences, byte by byte."""
    import numpy as np
    import zstandard

    steps = np.diff(keys.astype(np.uint64), prepend=np.uint64(0)).astype("<u4")
    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 4).T).tobytes())


def _unpacked(blob: bytes):
    import numpy as np
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u4").ravel(), dtype=np.uint64).astype(np.uint32)


def _rows(schema_names, types, columns):
    import pyarrow as pa

    return pa.table([pa.array(c, t) for c, t in zip(columns, types)], names=schema_names)


def _split(keys, count: int):
    """Places where sorted ``keys`` change, with the key of each part."""
    import numpy as np

    if not count:
        return []
    cut = np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [count]))
    return [(int(keys[a]), int(a), int(b)) for a, b in zip(cut[:-1], cut[1:])]


def _group_runs(texts, docs, least):
    """Runs of all chunks: anchor, content, count, doc_id, document, place in it, chunk and start there; and the chunks."""
    import numpy as np

    kept, found = [], []
    ids = np.array(docs, np.int64)
    for data, starts, ends, of, offset in chunks(texts, least):
        start, count, anchor, content, part = runs(data, starts, ends, least)
        place = start - starts[part] + offset[part]
        found.append((anchor, content, count, ids[of[part]], of[part], place, np.full(len(start), len(kept)), start))
        kept.append(data)
    if not found:
        return None, kept
    return [np.concatenate(x) for x in zip(*found)], kept


def _anchor_keys(anchor, buckets: int):
    """Bucket and 32 bits of each anchor, as one sortable number."""
    import numpy as np

    return (anchor % np.uint64(buckets) << np.uint64(32)) | (anchor >> np.uint64(32))


def listing(buckets: int, least: int):
    """Step 1: each group's distinct anchors by bucket."""

    def work(key, table):
        import numpy as np
        import pyarrow as pa

        texts, docs = _group(table)
        found, _ = _group_runs(texts, docs, least)
        keys = np.unique(_anchor_keys(found[0], buckets)) if found else np.zeros(0, np.uint64)
        parts = _split(keys >> np.uint64(32), len(keys))
        return _rows(["p", "r", "blob"], [pa.int64(), pa.int64(), pa.binary()], [[p for p, _, _ in parts], [key[0].as_py()] * len(parts), [_packed(keys[a:b] & np.uint64(0xFFFFFFFF)) for _, a, b in parts]])

    return work


def shared():
    """Which of each group's anchors other groups have, too: a bit for each."""

    def work(key, table):
        import numpy as np
        import pyarrow as pa

        blobs = [_unpacked(b) for b in table.column("blob").to_pylist()]
        keys = np.concatenate(blobs)
        order = np.argsort(keys, kind="stable")
        sorted_ = keys[order]
        same = sorted_[1:] == sorted_[:-1]
        many = np.zeros(len(keys), bool)
        many[order[1:][same]] = True
        many[order[:-1][same]] = True
        masks, at = [], 0
        for b in blobs:
            masks.append(np.packbits(many[at : at + len(b)]).tobytes())
            at += len(b)
        return _rows(["r", "p", "blob"], [pa.int64(), pa.int64(), pa.binary()], [table.column("r").to_pylist(), [key[0].as_py()] * len(blobs), masks])

    return work


def sending(buckets: int, spread: int, least: int):
    """Step 2: each group's contents that other documents may have, once each."""

    def work(key, table, masks):
        import numpy as np
        import pyarrow as pa
        import zstandard

        names, types = ["q", "r", "blob"], [pa.int64(), pa.int64(), pa.binary()]
        texts, docs = _group(table)
        found, data = _group_runs(texts, docs, least)
        if not found:
            return _rows(names, types, [[], [], []])
        anchor, content, count, doc, _, _, chunk, start = found
        keys = _anchor_keys(anchor, buckets)
        distinct, inverse = np.unique(keys, return_inverse=True)
        low, high = np.full(len(distinct), NOBODY), np.full(len(distinct), -NOBODY - 1)
        np.minimum.at(low, inverse, doc)
        np.maximum.at(high, inverse, doc)
        many = low != high
        told = dict(zip(masks.column("p").to_pylist(), masks.column("blob").to_pylist()))
        for p, a, b in _split(distinct >> np.uint64(32), len(distinct)):
            many[a:b] |= np.unpackbits(np.frombuffer(told[p], np.uint8), count=b - a).astype(bool)
        some = np.flatnonzero(many[inverse])
        if not len(some):
            return _rows(names, types, [[], [], []])
        contents, first, inverse = np.unique(content[some], return_index=True, return_inverse=True)
        low, high = np.full(len(contents), NOBODY), np.full(len(contents), -NOBODY - 1)
        np.minimum.at(low, inverse, doc[some])
        np.maximum.at(high, inverse, doc[some])
        at = some[first]
        bucket = (anchor[at] >> np.uint64(13)) % np.uint64(spread)
        order = np.argsort(bucket, kind="stable")
        press = zstandard.ZstdCompressor(level=3)
        blobs, parts = [], _split(bucket[order], len(order))
        for _, a, b in parts:
            own = order[a:b]
            raw = b"".join(data[c][s : s + n + least - 1].tobytes() for c, s, n in zip(chunk[at[own]].tolist(), start[at[own]].tolist(), count[at[own]].tolist()))
            head = (contents[own].astype("<u8"), low[own].astype("<i8"), high[own].astype("<i8"), (anchor[at[own]] >> np.uint64(32)).astype("<u4"), count[at[own]].astype("<u4"))
            blobs.append(press.compress(b"".join((len(own).to_bytes(8, "little"), *(h.tobytes() for h in head), raw))))
        return _rows(names, types, [[q for q, _, _ in parts], [key[0].as_py()] * len(parts), blobs])

    return work


def intervals(text, least: int = LEAST):
    """Suffixes in order, and where one differs from that before it within ``least`` bytes.

    The order is by 8, 16, 32 bytes and so on, until it is by ``least`` or
    more.  Then, on the transform, the boundaries within l + 1 bytes are those
    within l, each put before every byte: two neighbours in a byte's block
    stay together if no boundary is between them.  Which of two suffixes that
    agree so far comes first makes no difference.
    """
    import numpy as np

    n = len(text)
    padded = np.resize(text, n + 8).astype(np.uint64)  # the text is a circle, as its transform takes it
    key = np.zeros(n, np.uint64)
    for j in range(8):
        key = (key << np.uint64(8)) | padded[j : j + n]
    depth = 8
    while True:
        order = np.argsort(key)
        ranked = key[order]
        rank = np.empty(n, np.uint64)
        rank[order] = np.cumsum(np.concatenate(([True], ranked[1:] != ranked[:-1])), dtype=np.uint64)
        if depth >= least or rank[order[-1]] == n:
            break
        key = (rank << np.uint64(32)) | np.roll(rank, -depth)
        depth *= 2
    last = text[order - 1]
    back = np.argsort(last, kind="stable")
    blocks = np.concatenate(([True], last[back][1:] != last[back][:-1]))
    apart = np.zeros(n, bool)
    apart[0] = True
    inside, moved = np.empty(n, np.int32), np.empty(n, np.int32)
    for _ in range(least):
        np.cumsum(apart, dtype=np.int32, out=inside)
        np.take(inside, back, out=moved, mode="clip")
        further = blocks.copy()
        further[1:] |= moved[1:] != moved[:-1]
        if np.array_equal(further, apart):
            break
        apart = further
    return order, apart


def owners(contents: list[bytes], lows, least: int = LEAST):
    """The smallest doc_id of each string of the contents, one after another; ``lows`` has that of each content."""
    import numpy as np

    sizes = np.array([len(c) + 1 for c in contents])
    text = np.frombuffer(b"\xff".join(contents) + b"\xff", np.uint8)
    order, apart = intervals(text, least)
    doc = np.repeat(np.asarray(lows, np.int64), sizes)[order]
    begin = np.flatnonzero(apart)
    least_doc = np.empty(len(text), np.int64)
    least_doc[order] = np.repeat(np.minimum.reduceat(doc, begin), np.diff(np.concatenate((begin, [len(text)]))))
    # Only the strings that begin least bytes or more before a content's end.
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(text))
    return least_doc[left > least]


def owning(least: int):
    """Step 3: who owns each string of the contents of some anchors.

    Contents are the same where a 64-bit hash, length and half of the anchor's
    hash are, and then their bytes.  That contents of different anchors meet
    does no harm.
    """

    def work(key, table):
        import numpy as np
        import pyarrow as pa
        import zstandard

        unpress = zstandard.ZstdDecompressor()
        raws = [unpress.decompress(b) for b in table.column("blob").to_pylist()]
        sizes = [int.from_bytes(raw[:8], "little") for raw in raws]
        # Of each content: hash, smallest and largest doc_id, half of its anchor's hash, number of strings.
        kinds, widths = ("<u8", "<i8", "<i8", "<u4", "<u4"), (8, 8, 8, 4, 4)
        heads = [[np.frombuffer(raw, kind, n, 8 + n * sum(widths[:k])) for k, kind in enumerate(kinds)] for raw, n in zip(raws, sizes)]
        content, low, high, anchor, count = (np.concatenate(x) for x in zip(*heads))
        anchor, count = anchor.astype(np.uint64), count.astype(np.int64)
        row = np.repeat(np.arange(len(raws)), sizes)
        ends = np.concatenate([8 + n * sum(widths) + np.cumsum(h[4].astype(np.int64) + least - 1) for h, n in zip(heads, sizes)])
        _, first, inverse = np.unique(content ^ _mixed(anchor + count.astype(np.uint64)), return_index=True, return_inverse=True)
        span = lambda i: raws[row[i]][ends[i] - count[i] - least + 1 : ends[i]]
        again = np.flatnonzero(first[inverse] != np.arange(len(content)))
        other = [i for i, f in zip(again.tolist(), first[inverse[again]].tolist()) if span(i) != span(f)]
        if other:  # bytes that differ under one hash are classes of their own
            classes: dict[bytes, int] = {}
            for i in other:
                at = classes.setdefault(span(i), i)
                if at == i:
                    first = np.append(first, i)
                inverse[i] = np.flatnonzero(first == at)[0]
        lows = np.full(len(first), NOBODY)
        np.minimum.at(lows, inverse, low)
        order = np.argsort(anchor[first])
        _, counts = np.unique(anchor[first], return_counts=True)
        # A content whose anchor nothing else has is owned by its smallest doc_id as a whole.
        split_of, split_at, split_len, split_who = [], [], [], []

        def settle(some) -> None:
            own = first[some]
            texts = [raws[r][e - n : e] for r, e, n in zip(row[own].tolist(), ends[own].tolist(), (count[own] + least - 1).tolist())]
            who = owners(texts, lows[some], least)
            number = count[own]
            begin = np.concatenate(([0], np.cumsum(number)[:-1]))
            mixed = np.flatnonzero(np.add.reduceat(who != np.repeat(lows[some], number), begin, dtype=np.int64))
            if not len(mixed):
                return
            of = np.repeat(np.arange(len(some)), number)
            keep = np.zeros(len(some), bool)
            keep[mixed] = True
            change = np.concatenate(([True], (who[1:] != who[:-1]) | (of[1:] != of[:-1])))
            starts = np.flatnonzero(change)
            lengths = np.diff(np.concatenate((starts, [len(who)])))
            take = keep[of[starts]]
            starts, lengths = starts[take], lengths[take]
            split_of.append(some[of[starts]])
            split_at.append(starts - begin[of[starts]])
            split_len.append(lengths)
            split_who.append(who[starts])

        batch, size, at = [], 0, 0
        bytes_of = count[first] + least - 1
        for n in counts.tolist():
            some = order[at : at + n]
            at += n
            if n == 1:
                continue
            more = int(bytes_of[some].sum())
            if batch and size + more > TEXT:
                settle(np.concatenate(batch))
                batch, size = [], 0
            batch.append(some)
            size += more
        if batch:
            settle(np.concatenate(batch))
        # Answers: for each content sent, its owner, or the owners of its parts; only where some document loses by it.
        is_split = np.zeros(len(first), bool)
        plain = np.ones(len(content), bool)
        columns = []
        if split_of:
            of = np.concatenate(split_of)
            sort = np.argsort(of, kind="stable")
            of, part_at, part_len, part_who = of[sort], *(np.concatenate(x)[sort] for x in (split_at, split_len, split_who))
            is_split[of] = True
            plain = ~is_split[inverse]
            asked = np.flatnonzero(~plain)
            lo, hi = np.searchsorted(of, inverse[asked], "left"), np.searchsorted(of, inverse[asked], "right")
            sent = np.repeat(asked, hi - lo)
            part = np.arange(len(sent)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + np.repeat(lo, hi - lo)
            lost = part_who[part] < high[sent]
            sent, part = sent[lost], part[lost]
            columns.append((row[sent], content[sent], part_at[part], part_len[part], part_who[part]))
        whole = np.flatnonzero(plain & (lows[inverse] < high))
        columns.append((row[whole], content[whole], np.zeros(len(whole), np.int64), count[whole], lows[inverse[whole]]))
        to, *told = (np.concatenate(x) for x in zip(*columns))
        sort = np.argsort(to, kind="stable")
        told = np.stack([x[sort].view(np.uint64) for x in told]) if len(to) else np.zeros((4, 0), np.uint64)
        groups, out_r, out = table.column("r").to_pylist(), [], []
        for k, a, b in _split(to[sort], len(to)):
            out_r.append(groups[k])
            out.append(np.ascontiguousarray(told[:, a:b]).astype("<u8").tobytes())
        return _rows(["r", "q", "blob"], [pa.int64(), pa.int64(), pa.binary()], [out_r, [key[0].as_py()] * len(out), out])

    return work


def removing(least: int, keep: bool):
    """Step 4: each document without the bytes that it doesn't own."""

    def work(key, table, told):
        import hashlib

        import numpy as np
        import pyarrow as pa

        texts, docs = _group(table)
        sizes = np.array([len(t) for t in texts], np.int64)
        base = np.concatenate(([0], np.cumsum(sizes)))
        edge = np.zeros(base[-1] + 1, np.int32)
        blobs = [np.frombuffer(b, "<u8").reshape(4, -1) for b in told.column("blob").to_pylist()]
        if blobs:
            content, offset, length, owner = np.concatenate(blobs, axis=1)
            order = np.argsort(content, kind="stable")
            content, offset, length, owner = content[order], offset[order].astype(np.int64), length[order].astype(np.int64), owner[order].view(np.int64)
            for data, starts, ends, of, at in chunks(texts, least):
                start, _, _, own, part = runs(data, starts, ends, least)
                lo, hi = np.searchsorted(content, own, "left"), np.searchsorted(content, own, "right")
                hit = np.repeat(np.arange(len(own)), hi - lo)
                row = np.arange(len(hit)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + lo[hit]
                doc = np.array(docs, np.int64)[of[part[hit]]]
                lost = owner[row] < doc
                hit, row = hit[lost], row[lost]
                begin = base[of[part[hit]]] + start[hit] - starts[part[hit]] + at[part[hit]] + offset[row]
                np.add.at(edge, begin, 1)
                np.add.at(edge, begin + length[row] + least - 1, -1)
        gone = np.cumsum(edge[:-1]) > 0
        removed, spans, digests, kept = [], [], [], []
        for a, b, t in zip(base[:-1], base[1:], texts):
            g = gone[a:b]
            removed.append(int(g.sum()))
            spans.append(int(g[:1].sum() + (g[1:] & ~g[:-1]).sum()))
            rest = np.frombuffer(t, np.uint8)[~g].tobytes() if removed[-1] else t
            digests.append(hashlib.sha256(rest).hexdigest())
            kept.append(rest if keep else None)
        columns = [table.column("doc_id").to_pylist(), sizes.tolist(), removed, spans, digests] + [kept] * keep
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * keep
        return _rows(names, [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()][: len(names)], columns)

    return work


def deduplicate(docs: DataFrame, least: int = LEAST, keep: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row (doc_id, text), and with ``keep`` the kept bytes.

    A byte goes if a string of ``least`` bytes around it also starts in a
    document with a smaller doc_id; strings are those of the input.  Null
    texts are empty.  Very long ones are cut where no string is lost.  Rows
    with a null doc_id come after all others, and rows with one doc_id take
    nothing from each other, so repeated rows stay alike.  No rows give none.
    Other columns are not looked at, whatever their names.
    """
    if least < GRAM:
        raise ValueError(f"matches must have {GRAM} bytes or more")
    own = columns_apart(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    total = own.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    groups, buckets, spread = (max(1, -(-total // size)) for size in (GROUP, PER_ANCHORS, PER_CONTENTS))
    own = own.withColumn("r", F.pmod(F.xxhash64(F.lit("group"), "doc_id", "text"), F.lit(groups)))
    anchors = own.groupBy("r").applyInArrow(listing(buckets, least), "p long, r long, blob binary")
    masks = anchors.groupBy("p").applyInArrow(shared(), "r long, p long, blob binary")
    contents = own.groupBy("r").cogroup(masks.groupBy("r")).applyInArrow(sending(buckets, spread, least), "q long, r long, blob binary")
    told = contents.groupBy("q").applyInArrow(owning(least), "r long, q long, blob binary")
    shape = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep
    return own.groupBy("r").cogroup(told.groupBy("r")).applyInArrow(removing(least, keep), shape)
