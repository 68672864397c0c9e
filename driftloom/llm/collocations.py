"""Phrases whose words stand together more often than apart.

Contiguous patterns grow to the right, prefix by prefix.  Words that are rare
in their language can't be in a frequent phrase, so each occurrence of two
frequent words that follow each other is a prefix, and those that are frequent
are kept.  Every occurrence of a kept prefix points to what follows it in its
piece; these projections are tallied where they are read and sent to the task
of their prefix.  There a prefix is an interval of sorted pointers: each word
that follows often enough is a smaller interval, which is grown further before
the next one is looked at.

Words are handled by 64-bit hashes, or by their place among the frequent ones
where these are few enough to be sent to all tasks.  No two words of the corpus
share a hash: that is checked, and another seed taken where two do.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bounded, columns_apart, cut

#: Frequent words and prefixes that are sent to every task, 8 bytes each; beyond, nothing is pruned by them.
WORDS, PREFIXES = 1_000_000, 2_000_000
#: A prefix with more occurrences is dealt by the next word to so many tasks.
SPLIT, PARTS = 1_000_000, 16
#: Bytes of text that are split into words at once, and words that are tallied at once.
CHUNK, TALLY = 1 << 21, 1_500_000
#: Rows of a batch that goes to Spark: it is held there as a whole, outside the heap.
ROWS = 1 << 16
_BREAKS = bytes.maketrans(b".,;:!?\n\x0b\x0c\r\t", b"\n" * 10 + b" ")


def chunks(texts: list[str | None]) -> Iterator[bytes]:
    """Lower-case bytes of the texts, pieces ended by a line feed, about ``CHUNK`` at a time; no piece is cut."""
    held, size = [], 0
    for text in texts:
        raw = (text or "").encode("utf-8", "surrogatepass").lower().translate(_BREAKS)
        at = 0
        while len(raw) - at > CHUNK:
            end = raw.rfind(b"\n", at, at + CHUNK)
            end = raw.find(b"\n", at + CHUNK) if end < 0 else end
            if end < 0:
                break
            yield raw[at:end]
            at = end + 1
        held.append(raw[at:] if at else raw)
        size += len(held[-1])
        if size >= CHUNK:
            yield b"\n".join(held)
            held, size = [], 0
    yield b"\n".join(held)


def tokens(chunk: bytes) -> list[bytes]:
    """Words, and a line feed between pieces."""
    return [w for w in chunk.replace(b"\n", b" \n ").split(b" ") if w]


def _by_lang(batch) -> dict[str, list]:
    found: dict[str, list] = {}
    for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
        found.setdefault(lang, []).append(text)
    return found


def _words(docs: DataFrame, seed: int) -> DataFrame:
    """lang, id, word, f: all words and how often they occur."""

    def work(batches: Iterator):
        import pyarrow as pa
        import xxhash

        for batch in batches:
            for lang, texts in _by_lang(batch).items():
                found: Counter = Counter()
                for chunk in chunks(texts):
                    found.update(tokens(chunk))
                found.pop(b"\n", None)
                ids = pa.array([xxhash.xxh64_intdigest(w, seed) for w in found], pa.uint64()).view(pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found)), ids, pa.array(list(found), pa.binary()).cast(pa.string()), pa.array(found.values(), pa.int64())], ["lang", "id", "word", "f"])

    return docs.mapInArrow(work, "lang string, id long, word string, f long").groupBy("lang", "id", "word").agg(F.sum("f").alias("f"))


def _sorted_by_lang(rows: DataFrame, name: str) -> dict:
    """A bounded table (lang, value) as a sorted array for each lang."""
    import numpy as np

    table = rows.select("lang", name).toArrow()
    langs, values = table.column("lang").combine_chunks().dictionary_encode(), table.column(name).to_numpy()
    codes = langs.indices.to_numpy()
    return {lang: np.sort(values[codes == i]) for i, lang in enumerate(langs.dictionary.to_pylist())}


def _places(ids, known):
    """Where each id is among the known ones; -1 where it is not.  Without known ones the ids themselves, which are never -1."""
    import numpy as np

    if known is None:
        return ids
    if not len(known):
        return np.full(len(ids), -1, np.int64)
    at = np.searchsorted(known, ids)
    np.minimum(at, len(known) - 1, out=at)
    at[known[at] != ids] = -1
    return at


def _batches(columns: list, names: list[str]) -> Iterator:
    """The columns as batches of at most ``ROWS`` rows."""
    import pyarrow as pa

    whole = pa.RecordBatch.from_arrays(columns, names)
    for at in range(0, max(len(whole), 1), ROWS):
        yield whole.slice(at, ROWS)


def tally(columns: list) -> tuple[list, object]:
    """Distinct rows of equally long integer columns and their counts; a row may come twice, so sum them.

    The list is used up: each column is let go once its sorted copy is made.
    """
    import numpy as np

    mixed = np.zeros(len(columns[0]), np.uint64)
    for c in columns:
        mixed ^= c.view(np.uint64)
        mixed *= np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    order = np.argsort(mixed)
    del mixed, c
    rows = len(order)
    for i in range(len(columns)):
        columns[i] = columns[i][order]
    del order
    opens = np.zeros(rows, bool)
    opens[:1] = True
    for c in columns:
        opens[1:] |= c[1:] != c[:-1]
    at = np.flatnonzero(opens)
    return [c[at] for c in columns], np.diff(np.append(at, rows))


def _prefixes(docs: DataFrame, seed: int, words: dict | None) -> DataFrame:
    """lang, w1, w2, f: what follows each other, both frequent."""
    shared = docs.sparkSession.sparkContext.broadcast(words)

    def work(batches: Iterator):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for lang, texts in _by_lang(batch).items():
                for places in _placed(texts, seed, shared.value, lang):
                    first, second = places[:-1], places[1:]
                    both = np.flatnonzero((first != -1) & (second != -1))
                    columns = [first[both], second[both]]
                    del places, first, second, both
                    (a, b), n = tally(columns)
                    yield from _batches([pa.repeat(pa.scalar(lang, pa.string()), len(n)), pa.array(a), pa.array(b), pa.array(n, pa.int64())], ["lang", "w1", "w2", "f"])

    return docs.mapInArrow(work, "lang string, w1 long, w2 long, f long").groupBy("lang", "w1", "w2").agg(F.sum("f").alias("f"))


def _placed(texts: list, seed: int, words: dict | None, lang: str) -> Iterator:
    """Places of the words of many texts, -1 between pieces and for words that are not frequent."""
    import numpy as np
    import xxhash

    digest = xxhash.xxh64_intdigest
    known = None if words is None else words.get(lang, np.array([], np.int64))
    gap = np.array([digest(b"\n", seed)], np.uint64).view(np.int64)[0]

    def done(held):
        ids = np.concatenate(held)
        held.clear()
        breaks = np.flatnonzero(ids == gap)
        ids = _places(ids, known)
        ids[breaks] = -1
        return ids

    held, size = [], 0
    for chunk in chunks(texts):
        found = tokens(chunk) + [b"\n"]
        held.append(np.fromiter((digest(w, seed) for w in found), np.uint64, len(found)).view(np.int64))
        size += len(found)
        if size >= TALLY:
            yield done(held)
            size = 0
    if held:
        yield done(held)


def _pair(a, b):
    """One number for two places below 2^31."""
    return (a << 32) | b


def _pointers(docs: DataFrame, seed: int, most: int, words: dict | None, kept: dict | None, heavy: dict | None) -> DataFrame:
    """lang, w1..., part, n: what follows each occurrence of a kept prefix in its piece, as far as it can be frequent."""
    shared = docs.sparkSession.sparkContext.broadcast((words, kept, heavy))
    names = [f"w{k + 1}" for k in range(most)]

    def work(batches: Iterator):
        import numpy as np
        import pyarrow as pa

        words, kept, heavy = shared.value
        none = np.array([], np.int64)
        for batch in batches:
            for lang, texts in _by_lang(batch).items():
                for places in _placed(texts, seed, words, lang):
                    open_ = (places[:-1] != -1) & (places[1:] != -1)
                    if kept is not None:
                        pairs = _pair(places[:-1], places[1:])
                        open_ &= _places(pairs, kept.get(lang, none)) != -1
                        del pairs
                    open_ = np.append(open_, False)
                    at = np.flatnonzero(open_[:-1] & open_[1:])
                    columns, alive = [places[at], places[at + 1]], np.ones(len(at), bool)
                    for k in range(2, most):
                        to = np.minimum(at + k, len(places) - 1)
                        alive = alive & open_[to - 1] & (to == at + k)
                        columns.append(np.where(alive, places[to], -1))
                    del places, open_, at, alive
                    columns, n = tally(columns)
                    part = columns[2] % PARTS
                    if heavy is not None:
                        part = np.where(_places(_pair(columns[0], columns[1]), heavy.get(lang, none)) != -1, part, 0)
                    yield from _batches([pa.repeat(pa.scalar(lang, pa.string()), len(n)), *map(pa.array, columns), pa.array(part, pa.int64()), pa.array(n, pa.int64())], ["lang", *names, "part", "n"])

    return docs.mapInArrow(work, f"lang string, {', '.join(f'{w} long' for w in names)}, part long, n long")


def grown(columns: list, counts, least: int) -> list[tuple[list[int], int]]:
    """Frequent patterns of three and more columns in sorted rows, depth first; -1 ends a row."""
    import numpy as np

    total = np.concatenate(([0], np.cumsum(counts)))
    found: list[tuple[list[int], int]] = []

    def extend(low: int, high: int, depth: int, prefix: list[int]) -> None:
        own = columns[depth][low:high]
        cuts = low + np.concatenate(([0], np.flatnonzero(own[1:] != own[:-1]) + 1, [high - low]))
        sums = total[cuts[1:]] - total[cuts[:-1]]
        for k in np.flatnonzero(sums >= least).tolist():
            a, b = int(cuts[k]), int(cuts[k + 1])
            word = int(columns[depth][a])
            if word == -1:
                continue
            pattern = [*prefix, word]
            if depth >= 2:
                found.append((pattern, int(sums[k])))
            if depth + 1 < len(columns):
                extend(a, b, depth + 1, pattern)

    if len(counts):
        extend(0, len(counts), 0, [])
    return found


def _grow(pointers: DataFrame, most: int, least: int) -> DataFrame:
    """lang, ids, f of the frequent patterns of three words and more; each prefix is one task's."""
    names = [f"w{k + 1}" for k in range(most)]

    def work(batches: Iterator):
        import numpy as np
        import pyarrow as pa

        held, held_n, held_lang = None, None, None

        def done(lang, columns, counts):
            found = grown(columns, counts, least)
            return pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array([p for p, _ in found], pa.list_(pa.int64())), pa.array([n for _, n in found], pa.int64())], ["lang", "ids", "f"])

        for batch in batches:
            langs = batch.column(0).dictionary_encode()
            codes = langs.indices.to_numpy(zero_copy_only=False)
            edges = np.concatenate(([0], np.flatnonzero(codes[1:] != codes[:-1]) + 1, [len(codes)])) if len(codes) else [0, 0]
            for low, high in zip(edges[:-1], edges[1:]):
                if low == high:
                    continue
                lang = langs.dictionary[int(codes[low])].as_py()
                columns = [batch.column(1 + k).to_numpy()[low:high] for k in range(most)]
                counts = batch.column(1 + most).to_numpy()[low:high]
                if held is not None and lang == held_lang:
                    columns, counts = [np.concatenate(x) for x in zip(held, columns)], np.concatenate((held_n, counts))
                elif held is not None:
                    yield done(held_lang, held, held_n)
                # The last prefix may go on in the next batch.
                same = (columns[0] == columns[0][-1]) & (columns[1] == columns[1][-1])
                whole = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0
                if whole:
                    yield done(lang, [c[:whole] for c in columns], counts[:whole])
                held, held_n, held_lang = _folded([c[whole:] for c in columns], counts[whole:]) + (lang,)
        if held is not None:
            yield done(held_lang, held, held_n)

    dealt = pointers.repartition("lang", "w1", "w2", "part").sortWithinPartitions("lang", *names)
    return dealt.select("lang", *names, "n").mapInArrow(work, "lang string, ids array<long>, f long").groupBy("lang", "ids").agg(F.sum("f").alias("f"))


def _folded(columns: list, counts) -> tuple[list, object]:
    """Sorted rows, equal ones as one."""
    import numpy as np

    opens = np.ones(len(counts), bool)
    opens[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    at = np.flatnonzero(opens)
    return [c[at] for c in columns], np.add.reduceat(counts, at) if len(at) else counts


def _score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 a a / (left right)), exact for counts up to 10^15: products have 38 digits at most."""
    wide = lambda c: c.cast("decimal(19,0)")
    return F.call_function("div", wide(a) * wide(a) * F.lit(1_000_000).cast("decimal(7,0)"), wide(left) * wide(right))


def mine(docs: DataFrame, longest: int = 3, least: int = 10, cover: int = 50, top: int | None = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the phrases of 2 to ``longest`` words of each lang of (text, lang).

    Texts are lower-cased (A to Z), split at ``.,;:!?`` and line ends into
    pieces and these at blanks and tabs into words.  A phrase that occurs
    ``least`` times counts, unless a longer one with ``cover`` percent of its
    occurrences holds it.  Its score is that of its worst cut, of equal ones
    the first.  Null texts are empty, a null lang is ``und``; an empty text has
    no words, very long ones are read whole in parts, repeated rows count each.
    Equal ranks are broken by the phrase's bytes.  No rows, or no frequent
    phrase, give none.  Other columns are ignored, whatever their names.
    """
    own = columns_apart(docs, "text", "lang").select("text", F.coalesce("lang", F.lit("und")).alias("lang"))
    names, seed = _named(own)
    totals = names.groupBy("lang").agg(F.sum("f").alias("n"))
    often = names.where(F.col("f") >= least)
    words = _sorted_by_lang(often.select("lang", "id"), "id") if bounded(often, WORDS) else None
    often = _place_column(often, words)
    prefixes = cut(_prefixes(own, seed, words).where(F.col("f") >= least), "prefixes")
    kept = heavy = None
    if words is not None and bounded(prefixes, PREFIXES):
        packed = prefixes.select("lang", F.shiftleft("w1", 32).bitwiseOR(F.col("w2")).alias("pair"), "f")
        kept = _sorted_by_lang(packed.select("lang", "pair"), "pair")
        heavy = _sorted_by_lang(packed.where(F.col("f") > SPLIT).select("lang", "pair"), "pair")
    pairs = prefixes.select("lang", F.array("w1", "w2").alias("ids"), "f")
    found = pairs
    if longest > 2:
        found = pairs.unionByName(_grow(_pointers(own, seed, longest, words, kept, heavy), longest, least))
    found = cut(found, "patterns")
    counts = found.unionByName(often.select("lang", F.array("place").alias("ids"), "f"))
    # What a longer phrase covers.
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.size("ids") - 1), lambda k: F.transform(F.sequence(F.lit(1), F.size("ids") - k + 1), lambda i: F.slice("ids", i, k))))
    longer = found.where(F.size("ids") > 2).select("lang", F.explode(inner).alias("ids"), "f").groupBy("lang", "ids").agg(F.max("f").alias("over"))
    free = found.withColumnRenamed("f", "a").join(longer, ["lang", "ids"], "left").where(F.coalesce(F.col("over") * 100 < F.col("a") * cover, F.lit(True))).drop("over")
    # Every cut: how often its two parts occur.
    cuts = free.select("lang", "ids", "a", F.explode(F.sequence(F.lit(1), F.size("ids") - 1)).alias("k"))
    cuts = cuts.select("*", F.slice("ids", F.lit(1), F.col("k")).alias("first"), F.slice("ids", F.col("k") + 1, F.size("ids") - F.col("k")).alias("rest"))
    cuts = cuts.join(counts.select("lang", F.col("ids").alias("first"), F.col("f").alias("l")), ["lang", "first"])
    cuts = cuts.join(counts.select("lang", F.col("ids").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    worst = F.min(F.struct(_score(F.col("a"), F.col("l"), F.col("r")).cast("long").alias("score"), "k", "l", "r")).alias("worst")
    scored = cuts.groupBy("lang", "ids").agg(F.first("a").alias("a"), worst).select("lang", "ids", "a", "worst.l", "worst.r", "worst.score")
    if top is not None:  # phrases are spelt out only for those that may be listed
        by = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
        scored = scored.withColumn("at", F.rank().over(by)).where(F.col("at") <= top).drop("at")
    scored = cut(scored, "scored")
    spelt = scored.select("lang", "ids", F.posexplode("ids").alias("at", "place")).join(often.select("lang", "place", "word"), ["lang", "place"])
    spelt = spelt.groupBy("lang", "ids").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    listed = scored.join(spelt, ["lang", "ids"]).join(totals, "lang")
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")).cast("long")
    ranked = listed.withColumn("rank", place)
    if top is not None:
        ranked = ranked.where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def _named(docs: DataFrame) -> tuple[DataFrame, int]:
    """All words, and a seed with which no two of a lang share a hash, nor one that of the break."""
    import xxhash

    for seed in range(100):
        words = cut(_words(docs, seed), "words")
        gap = xxhash.xxh64_intdigest(b"\n", seed)
        gap -= (gap >> 63) << 64
        twice = words.groupBy("lang", "id").agg(F.count(F.lit(1)).alias("many")).where((F.col("many") > 1) | F.col("id").isin(gap, -1))
        if not twice.limit(1).count():
            return words, seed
    raise RuntimeError("words share hashes under every seed")


def _place_column(often: DataFrame, words: dict | None) -> DataFrame:
    """``often`` with the place of each word: that among its lang's sorted ids, or its id."""
    if words is None:
        return often.withColumn("place", F.col("id"))
    shared = often.sparkSession.sparkContext.broadcast(words)

    def work(batches: Iterator):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            langs, ids = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            at = [int(np.searchsorted(shared.value[g], i)) for g, i in zip(langs, ids)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at, pa.int64())], ["lang", "id", "word", "f", "place"])

    return cut(often.select("lang", "id", "word", "f").mapInArrow(work, "lang string, id long, word string, f long, place long"), "often")
