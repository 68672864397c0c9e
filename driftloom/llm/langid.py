"""Language identification by segmentation-marginalised unigrams.

Each language has probabilities over the pieces of a fixed public vocabulary.
The likelihood of a word sums those of all its segmentations, by the forward
algorithm; the pieces are fitted by expected counts (forward-backward), a few
rounds from the counts of all matches.  Pieces never cross words, so a text's
likelihood is the product of its words', and a word is scored once a worker.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns_apart, cut, held_out

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: About so many documents a language are learnt from, at most; rounds of fitting.
TRAIN_DOCS, ROUNDS = 2000, 3
#: Longest word; a longer one is cut into such.
WORD = 32
#: Words that a worker remembers; probability of a character outside the vocabulary; share of the common model.
MEMORY, UNKNOWN, COMMON = 400_000, 1e-8, 0.02
LETTERS = re.compile(r"[^\W\d_]+")
START = "▁"


def vocabulary(path: str = VOCABULARY) -> list[str]:
    """The vocabulary's pieces of lower-case letters; on the driver."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = {model.id_to_piece(i) for i in range(model.get_piece_size())}
    return sorted(p for p in pieces if len(p) <= WORD + 1 and p == p.lower() and p.replace(START, "", 1).isalpha())


class Index(dict):
    """Place of each piece, and the length of the longest."""

    def __init__(self, pieces: list[str]):
        super().__init__(zip(pieces, range(len(pieces))))
        self.longest = max(map(len, pieces), default=1)


def words_of(text: str) -> list[str]:
    """Runs of letters in lower case, cut to WORD letters; none if nothing is a letter."""
    found = LETTERS.findall(text.lower())
    if not any(c.isalpha() for w in found for c in w):
        return []
    if max(map(len, found)) <= WORD:
        return found
    return [w[i : i + WORD] for w in found for i in range(0, len(w), WORD)]


class Lattice:
    """Pieces that end at each place of each word, for words of one length."""

    def __init__(self, words: list[str], index: Index, unknown: int):
        import numpy as np

        self.size = size = len(words[0]) + 1
        self.longest = index.longest
        self.ids = np.full((size, min(self.longest, size), len(words)), unknown + 1, np.int32)  # unknown + 1: no piece
        get = index.get
        for e in range(1, size + 1):
            for n in range(1, min(self.longest, e) + 1):
                a = e - n
                self.ids[e - 1, n - 1] = [get((START + w)[a:e], unknown + (n > 1)) for w in words] if a == 0 else [get(w[a - 1 : e - 1], unknown + (n > 1)) for w in words]

    def forward(self, prob):
        """alpha[place, word, language]; prob has a last row of zeros."""
        import numpy as np

        alpha = np.zeros((self.size + 1, self.ids.shape[2], prob.shape[1]))
        alpha[0] = 1
        for e in range(1, self.size + 1):
            for n in range(1, min(self.longest, e) + 1):
                alpha[e] += alpha[e - n] * prob[self.ids[e - 1, n - 1]]
        return alpha

    def expected(self, prob, weight):
        """Expected counts of each piece; prob has one column, weight is by word."""
        import numpy as np

        alpha, beta = self.forward(prob)[:, :, 0], np.zeros((self.size + 1, self.ids.shape[2]))
        beta[self.size] = 1
        total, p = np.zeros(len(prob)), prob[:, 0]
        for e in range(self.size, 0, -1):
            for n in range(1, min(self.longest, e) + 1):
                beta[e - n] += beta[e] * p[self.ids[e - 1, n - 1]]
        scale = weight / alpha[self.size]
        for e in range(1, self.size + 1):
            for n in range(1, min(self.longest, e) + 1):
                own = self.ids[e - 1, n - 1]
                total += np.bincount(own, alpha[e - n] * p[own] * beta[e] * scale, len(prob))
        return total

    def matches(self, weight, rows: int):
        import numpy as np

        return sum(np.bincount(i, weight, rows) for e in self.ids for i in e)


def by_length(words: list[str], step: int = 4096) -> Iterator[tuple[list[int], list[str]]]:
    """Places and words of equal length, some thousand at a time."""
    order: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        order.setdefault(len(w), []).append(i)
    for places in order.values():
        for a in range(0, len(places), step):
            yield places[a : a + step], [words[i] for i in places[a : a + step]]


def word_scores(words: list[str], index: Index, prob):
    """log likelihood of each word in each language."""
    import numpy as np

    out = np.empty((len(words), prob.shape[1]))
    for places, some in by_length(words):
        out[places] = np.log(np.maximum(Lattice(some, index, len(index)).forward(prob)[-1], 1e-300))
    return out


def _smoothed(counts, share: float = COMMON):
    """Probabilities [pieces + unknown + none, languages] from counts."""
    import numpy as np

    counts = counts[:-2]
    common = (counts.sum(1) + 0.01) / (counts.sum() + 0.01 * len(counts))
    own = counts / np.maximum(counts.sum(0), 1e-9)
    prob = (1 - share) * own + share * common[:, None]
    return np.vstack([prob, np.full((1, prob.shape[1]), UNKNOWN), np.zeros((1, prob.shape[1]))])


def train(docs: DataFrame, path: str = VOCABULARY, docs_per_lang: int = TRAIN_DOCS, rounds: int = ROUNDS):
    """languages and piece probabilities, from rows (doc_id, text, lang).

    Rows with null lang or text don't count.  Of each language about
    ``docs_per_lang`` documents are learnt from, whole, chosen by a hash of doc_id.
    """
    import numpy as np

    pieces = vocabulary(path)
    index = Index(pieces)
    rows = columns_apart(docs, "doc_id", "text", "lang").where("text is not null and lang is not null")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    langs = sorted(sizes)
    if not langs:
        return [], pieces, np.zeros((len(pieces) + 2, 0))
    share = F.element_at(F.create_map(*[F.lit(x) for lang in langs for x in (lang, min(1.0, docs_per_lang / sizes[lang]))]), F.col("lang"))
    chosen = rows.where(F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1 << 40)) / F.lit(float(1 << 40)) < share)

    def count(batches):
        import pyarrow as pa

        for batch in batches:
            found: Counter = Counter()
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for w, n in Counter(words_of(text)).items():
                    found[lang, w] += n
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in found], pa.string()), pa.array([k[1] for k in found], pa.string()), pa.array(list(found.values()), pa.int64())], ["lang", "word", "n"])

    words = chosen.select("text", "lang").mapInArrow(count, "lang string, word string, n long")
    words = cut(words.groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")
    shared = words.sparkSession.sparkContext.broadcast((index, langs))

    def fit(prob):
        now = words.sparkSession.sparkContext.broadcast(prob)

        def expect(batches):
            import pyarrow as pa

            index, langs = shared.value
            prob = now.value
            total = np.zeros((len(index) + 2, len(langs)))
            for batch in batches:
                lang, text, n = (batch.column(i).to_pylist() for i in range(3))
                for g, name in enumerate(langs):
                    at = [i for i, x in enumerate(lang) if x == name]
                    weights = np.array([n[i] for i in at], float)
                    for places, some in by_length([text[i] for i in at]):
                        lattice = Lattice(some, index, len(index))
                        total[:, g] += lattice.matches(weights[places], len(total)) if prob is None else lattice.expected(prob[:, g : g + 1], weights[places])
            piece, g = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(piece, pa.int64()), pa.array(g, pa.int64()), pa.array(total[piece, g])], ["piece", "lang", "n"])

        sums = words.mapInArrow(expect, "piece long, lang long, n double").groupBy("piece", "lang").agg(F.sum("n").alias("n")).collect()
        total = np.zeros((len(index) + 2, len(langs)))
        for r in sums:
            total[r["piece"], r["lang"]] = r["n"]
        return _smoothed(total)

    prob = None
    for _ in range(rounds + 1):
        prob = fit(prob)
    return langs, pieces, prob


class Predictor:
    """Predicts texts; remembers the words that it has scored."""

    def __init__(self, langs: list[str], pieces: list[str], prob):
        import numpy as np

        self.langs, self.index, self.prob = langs, Index(pieces), prob
        self.known: dict[str, int] = {}
        self.table = np.zeros((0, len(langs)))

    def __call__(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Language and score of each text."""
        import numpy as np

        counts = [Counter(words_of(t)) if t and self.langs else None for t in texts]
        if len(self.known) > MEMORY:
            self.known, self.table = {}, np.zeros((0, len(self.langs)))
        known = self.known
        new = list({w for c in counts if c for w in c if w not in known})
        if new:
            used = len(known)
            known.update(zip(new, range(used, used + len(new))))
            self.table = _grown(self.table, used, word_scores(new, self.index, self.prob))
        out = []
        for c in counts:
            if not c:
                out.append(("und", 0.0))
                continue
            total = np.fromiter(c.values(), float, len(c)) @ self.table[np.fromiter(map(known.__getitem__, c), np.int64, len(c))]
            best = int(total.argmax())
            out.append((self.langs[best], float(1 / np.exp(total - total[best]).sum())))
        return out


def predict(docs: DataFrame, model) -> DataFrame:
    """doc_id, lang_pred, score of every row (doc_id, text).

    ``und`` with score 0 where the text is null or has no letter, or where no
    language was learnt.  The score is the language's share of the likelihood.
    Very long texts are scored whole, in parts that are added up; no rows give
    none; other columns are ignored, whatever their names.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches):
        import pyarrow as pa

        ask = Predictor(*shared.value)
        for batch in batches:
            for part in (batch.slice(i, 200) for i in range(0, len(batch), 200)):
                said = ask(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x[0] for x in said], pa.string()), pa.array([x[1] for x in said], pa.float64())], ["doc_id", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return columns_apart(docs, "doc_id", "text").mapInArrow(work, f"doc_id {kind}, lang_pred string, score double")


def accepted(docs: DataFrame, path: str = VOCABULARY, least: float = 0.4) -> DataFrame:
    """The rows of ``docs``, all columns, whose text has a language with a score of ``least``.

    Learnt from the rows that are not held out.  Where none of these has a
    language, nothing can be learnt and every text with a letter is accepted.
    Null texts, and those without a letter, are not.  Very long texts are read
    whole.  Repeated rows are rows of their own; no rows give none.
    """
    model = train(docs.where(~held_out(F.col("doc_id"), 4, 2)), path)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index("text")

    def work(batches):
        import pyarrow as pa

        ask = Predictor(*shared.value)
        for batch in batches:
            for part in (batch.slice(i, 200) for i in range(0, len(batch), 200)):
                texts = part.column(place).to_pylist()
                good = [lang != "und" and score >= least for lang, score in ask(texts)] if ask.langs else [bool(words_of(t or "")) for t in texts]
                yield part.filter(pa.array(good, pa.bool_()))

    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])  # a dot in a name would be read as a field
    return plain.mapInArrow(work, plain.schema).toDF(*docs.columns)


def _grown(table, used: int, rows):
    """``rows`` written behind the first ``used`` ones; room doubles as needed."""
    import numpy as np

    if used + len(rows) > len(table):
        more = np.empty((max(2 * len(table), used + len(rows)), table.shape[1]))
        more[:used] = table[:used]
        table = more
    table[used : used + len(rows)] = rows
    return table


def identify(docs: DataFrame, path: str = VOCABULARY, docs_per_lang: int = TRAIN_DOCS) -> DataFrame:
    """doc_id, held_out, lang_pred, score: learnt from the rows not held out, for all.

    A row is held out where crc32 of its doc_id as text leaves 2 by 4; a null
    doc_id is not.  Repeated rows are rows of their own.  Texts are scored
    whole, however long.  No rows give none.  Columns besides doc_id, text and
    lang are ignored, whatever their names.
    """
    out = held_out(F.col("doc_id"), 4, 2)
    model = train(docs.where(~out), path, docs_per_lang)
    return predict(docs, model).select("doc_id", out.alias("held_out"), "lang_pred", "score")
