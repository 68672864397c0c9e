"""Toxicity by a bidirectional gated recurrent network with attention pooling.

Each word is an input of three parts: a vector of its own, where it was learnt,
the mean vector of its hashed character n-grams, and how its word and its
strongest n-grams lean in the labels.  Two gated recurrent layers read a window
of words in both directions, attention weighs their states, and one logistic
unit scores the window.  All overlapping windows of a text are scored; the
text's score is the highest of them.  Training and scoring are numpy; labels
are only known of documents, so training takes each text's window that leans
most, and then those that the network itself scores highest.

How words lean in a training text is told by the labels of the other folds
only, so the network learns how far leanings can be relied on in texts whose
labels they don't come from; scoring uses the leanings of all folds.
"""

from __future__ import annotations

import re
from collections import Counter
from zlib import crc32

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns_apart, held_out

#: Documents learnt from at most (by a hash of doc_id), words in a window, and between two windows.
TRAIN_DOCS, WINDOW, STRIDE = 3000, 32, 16
#: Words with own vectors, buckets of character n-grams, sizes of vectors and of the state.
VOCABULARY, BUCKETS, VECTOR, STATE = 4096, 1 << 14, 6, 8
#: Bytes of n-grams anywhere in a word, and of those at its start, which ``^`` marks.
GRAM, STARTS = 4, (5, 6, 7)
ROUNDS, STEPS, BATCH, RATE, DECAY = 3, 150, 128, 0.01, 0.02
#: Folds of leanings, documents of label 1 that must have what leans to it, and inputs that say how a word leans.
FOLDS, SEEN, LEAN = 5, 3, 2
#: Occurrences that a document counts, and the log odds from which something leans.
OFTEN, LEAST_LEAN = 4, 1.2
#: Words that a worker remembers, and from which score on a text is predicted toxic.
MEMORY, THRESHOLD = 250_000, 0.7
LETTERS = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    return LETTERS.findall(text.lower())


def grams_of(word: str) -> list[bytes]:
    """Byte n-grams of the whole word, and its beginnings."""
    marked = b"^" + word.encode("utf-8", "surrogatepass")
    inside = [marked[i : i + GRAM] for i in range(max(1, len(marked) - GRAM + 1))]
    return inside + [marked[:n] for n in STARTS if n < len(marked)]


class Leanings:
    """How words and n-grams lean to label 1: smoothed log odds of their occurrences, of all or without a fold.

    A document counts an occurrence up to ``OFTEN`` times.  Only what ``SEEN``
    documents of label 1 have can lean.
    """

    def __init__(self, docs: list[list[str]], labels, folds: int = FOLDS):
        self.folds = max(1, min(folds, sum(labels)))
        self.fold_of = [0] * len(docs)
        for y in (0, 1):  # each fold has its share of both labels
            for n, i in enumerate(i for i, label in enumerate(labels) if label == y):
                self.fold_of[i] = n % self.folds
        self.sizes = [[0, 0] for _ in range(self.folds)]
        for y, f in zip(labels, self.fold_of):
            self.sizes[f][y] += 1
        words = [Counter(ws) for ws in docs]
        self.counts = [self._counted(words, labels), None]
        for ws in words:
            grams: Counter = Counter()
            for w, n in ws.items():
                for g in set(grams_of(w)):
                    grams[g] += n
            ws.clear()
            ws.update(grams)
        self.counts[1] = self._counted(words, labels)

    def _counted(self, docs: list[Counter], labels) -> dict:
        """Of each candidate, by fold: occurrences in documents of label 0 and 1, and documents of label 1."""
        seen: Counter = Counter()
        for found, y in zip(docs, labels):
            if y:
                seen.update(found.keys())
        out = {g: [[0, 0, 0] for _ in range(self.folds)] for g, n in seen.items() if n >= SEEN}
        for found, y, f in zip(docs, labels, self.fold_of):
            for g in found.keys() & out.keys():
                cell = out[g][f]
                cell[y] += min(found[g], OFTEN)
                cell[2] += y
        return out

    def told(self, fold: int | None = None) -> tuple[dict, dict]:
        """Leanings of words and of n-grams, by the documents outside ``fold``."""
        from math import log

        use = [f for f in range(self.folds) if f != fold or self.folds == 1]
        clean, toxic = (sum(self.sizes[f][y] for f in use) for y in (0, 1))
        base = (toxic + 0.5) / (clean + toxic + 1)
        out = []
        for counts in self.counts:
            lean = {}
            for g, by in counts.items():
                m, n, docs = (sum(by[f][k] for f in use) for k in range(3))
                if docs < SEEN:
                    continue
                odds = log((n + 0.3 * base) / (m + 0.3 * (1 - base))) - log(base / (1 - base))
                sure = odds * docs / (docs + 2)
                if sure > LEAST_LEAN:
                    lean[g] = min(sure, 6.0) / 4
            out.append(lean)
        return out[0], out[1]


def _summed(rows, to, size: int):
    """Rows added up by the row of the result that each goes to."""
    import numpy as np

    return np.stack([np.bincount(to, column, size) for column in np.ascontiguousarray(rows.T)], axis=1)


class Network:
    """The weights, and scoring of windows of word inputs."""

    def __init__(self, words: dict[str, int], lean_word: dict[str, float], lean_gram: dict[bytes, float], seed: int = 7):
        import numpy as np

        rng = np.random.default_rng(seed)
        self.words, self.lean_word, self.lean_gram = words, lean_word, lean_gram
        self.memo: dict = {}  # descriptions of the words of training windows
        wide, h = 2 * VECTOR + LEAN, STATE
        self.p = {
            "word": rng.normal(0, 0.1, (len(words) + 1, VECTOR)),
            "gram": rng.normal(0, 0.1, (BUCKETS, VECTOR)),
            "att": rng.normal(0, 0.3, 2 * h),
            "out": rng.normal(0, 0.3, 2 * h),
            "bias": np.zeros(1),
        }
        for d in "fb":
            self.p["W" + d] = rng.normal(0, 1 / np.sqrt(wide), (wide, 3 * h))
            self.p["U" + d] = rng.normal(0, 1 / np.sqrt(h), (h, 3 * h))
            self.p["B" + d] = np.zeros(3 * h)

    def describe(self, word: str, leans: tuple[dict, dict] | None = None) -> tuple[int, list[int], float, float]:
        """Row of the word, buckets of its n-grams, and both leanings: its own, and the mean of its two strongest n-grams'."""
        of_word, of_gram = leans or (self.lean_word, self.lean_gram)
        grams = grams_of(word)
        best = sorted((of_gram.get(g, 0.0) for g in grams), reverse=True)[:2]
        return self.words.get(word, len(self.words)), [crc32(g) % BUCKETS for g in grams], of_word.get(word, 0.0), sum(best) / 2

    def inputs(self, words: list[str], leans: tuple[dict, dict] | None = None, told: list | None = None):
        """One row of inputs for each word, and what it was made of; ``told`` has the words' descriptions if they are known."""
        import numpy as np

        told = told if told is not None else [self.describe(w, leans) for w in words]
        sizes = np.array([len(t[1]) for t in told])
        flat = np.fromiter((b for t in told for b in t[1]), np.int64, int(sizes.sum()))
        starts = np.concatenate(([0], np.cumsum(sizes)[:-1])).astype(int)
        rows = np.array([t[0] for t in told])
        gram = np.add.reduceat(self.p["gram"][flat], starts, axis=0) / sizes[:, None] if len(told) else np.zeros((0, VECTOR))
        lean = np.array([t[2:] for t in told]).reshape(-1, LEAN)
        return np.hstack([self.p["word"][rows], gram, lean]), (rows, flat, sizes)

    @staticmethod
    def _gates(x, s, u):
        """Next state from projected input x [n, 3h] and state s: update, reset, candidate."""
        import numpy as np

        h = s.shape[1]
        su = s @ u
        zr = 0.5 + 0.5 * np.tanh(0.5 * (x[:, : 2 * h] + su[:, : 2 * h]))
        z, r = zr[:, :h], zr[:, h:]
        c = np.tanh(x[:, 2 * h :] + r * su[:, 2 * h :])
        return s + z * (c - s), z, r, c, su

    def forward(self, xf, xb, keep: bool = False):
        """Scores of windows from inputs [time, n, 3h] of both directions."""
        import numpy as np

        time, n = xf.shape[:2]
        h = STATE
        states = np.zeros((time, n, 2 * h), xf.dtype)
        trace = {"f": [], "b": []}
        for d, x in (("f", xf), ("b", xb)):
            s = np.zeros((n, h), xf.dtype)
            u = self.p["U" + d].astype(xf.dtype)
            for t in range(time) if d == "f" else range(time - 1, -1, -1):
                before = s
                s, z, r, c, su = self._gates(x[t], s, u)
                states[t, :, slice(0, h) if d == "f" else slice(h, 2 * h)] = s
                if keep:
                    trace[d].append((t, before, z, r, c, su))
        e = states @ self.p["att"].astype(xf.dtype)
        e = np.exp(e - e.max(0))
        a = e / e.sum(0)
        pooled = (a[:, :, None] * states).sum(0)
        score = 0.5 + 0.5 * np.tanh(0.5 * (pooled @ self.p["out"].astype(xf.dtype) + self.p["bias"].astype(xf.dtype)))
        return (score, states, a, pooled, trace) if keep else score

    def projected(self, x):
        return x @ self.p["Wf"] + self.p["Bf"], x @ self.p["Wb"] + self.p["Bb"]

    def gradients(self, windows: list[list[str]], labels, folds: list[int] | None = None, leans: list[tuple[dict, dict]] | None = None):
        """Loss and gradient of the mean cross entropy of windows; shorter ones are padded with nothing.

        ``folds`` says which of ``leans`` tells how a window's words lean.
        """
        import numpy as np

        p, h = self.p, STATE
        folds = folds or [0] * len(windows)
        types = sorted({(w, f) for ws, f in zip(windows, folds) for w in ws})
        index = {t: i + 1 for i, t in enumerate(types)}
        for t in types:
            if t not in self.memo:
                self.memo[t] = self.describe(t[0], leans[t[1]] if leans else None)
        x, (rows, flat, sizes) = self.inputs([], told=[self.memo[t] for t in types])
        x = np.vstack([np.zeros((1, x.shape[1])), x])
        time = max(map(len, windows))
        ids = np.array([[index[w, f] for w in ws] + [0] * (time - len(ws)) for ws, f in zip(windows, folds)]).T
        pf, pb = self.projected(x)
        score, states, a, pooled, trace = self.forward(pf[ids], pb[ids], keep=True)
        y, n = np.asarray(labels, float), len(labels)
        loss = -(y * np.log(score + 1e-9) + (1 - y) * np.log(1 - score + 1e-9)).mean()
        d_logit = (score - y) / n
        g = {k: np.zeros_like(v) for k, v in p.items()}
        g["out"], g["bias"] = pooled.T @ d_logit, np.array([d_logit.sum()])
        d_pool = d_logit[:, None] * p["out"]
        d_a = (states * d_pool).sum(2)
        d_e = a * (d_a - (a * d_a).sum(0))
        g["att"] = np.einsum("tn,tnh->h", d_e, states)
        d_states = a[:, :, None] * d_pool + d_e[:, :, None] * p["att"]
        d_x = np.zeros_like(x)
        for d, proj in (("f", pf), ("b", pb)):
            u, part = p["U" + d], slice(0, h) if d == "f" else slice(h, 2 * h)
            d_s, d_all = np.zeros((n, h)), np.empty((time, n, 3 * h))
            for t, before, z, r, c, su in reversed(trace[d]):
                d_s = d_s + d_states[t][:, part]
                d_z, d_c = d_s * (c - before) * z * (1 - z), d_s * z * (1 - c * c)
                d_r = d_c * su[:, 2 * h :] * r * (1 - r)
                d_in = np.hstack([d_z, d_r, d_c])
                d_su = np.hstack([d_z, d_r, d_c * r])
                g["U" + d] += before.T @ d_su
                d_all[t] = d_in
                d_s = d_s * (1 - z) + d_su @ u.T
            d_proj = _summed(d_all.reshape(-1, 3 * h), ids.ravel(), len(proj))
            g["W" + d], g["B" + d] = x.T @ d_proj, d_proj.sum(0)
            d_x += d_proj @ p["W" + d].T
        d_x = d_x[1:]
        g["word"] = _summed(d_x[:, :VECTOR], rows, len(g["word"]))
        g["gram"] = _summed(np.repeat(d_x[:, VECTOR : 2 * VECTOR] / sizes[:, None], sizes, axis=0), flat, BUCKETS)
        return loss, g

    def fit(self, windows: list[list[str]], labels, steps: int, seed: int, folds: list[int] | None = None, leans=None) -> None:
        """Adam over batches with three windows of label 0 to one of label 1."""
        import numpy as np

        rng = np.random.default_rng(seed)
        sides = [[i for i, y in enumerate(labels) if y == k] for k in (0, 1)]
        if not all(sides):
            return
        m, v = ({k: np.zeros_like(x) for k, x in self.p.items()} for _ in range(2))
        for step in range(1, steps + 1):
            chosen = np.concatenate([rng.choice(s, n) for s, n in zip(sides, (BATCH * 3 // 4, BATCH // 4))])
            _, g = self.gradients([windows[i] for i in chosen], [labels[i] for i in chosen], [folds[i] for i in chosen] if folds else None, leans)
            for k, x in self.p.items():
                if k in ("word", "gram"):  # little data must not be learnt by heart
                    x *= 1 - DECAY
                m[k] += 0.1 * (g[k] - m[k])
                v[k] += 0.01 * (g[k] ** 2 - v[k])
                x -= RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)


class Scorer:
    """Scores texts; remembers the projected inputs of words."""

    def __init__(self, net: Network, leans: tuple[dict, dict] | None = None):
        import numpy as np

        self.net, self.known, self.leans = net, {}, leans
        self.table = [np.zeros((0, 3 * STATE), np.float32)] * 2

    def _learn(self, words: set[str]) -> None:
        import numpy as np

        if len(self.known) > MEMORY:
            self.known, self.table = {}, [np.zeros((0, 3 * STATE), np.float32)] * 2
        known = self.known
        new = [w for w in words if w not in known]
        for i in range(0, len(new), 20_000):
            part = new[i : i + 20_000]
            used = len(known)
            rows = self.net.projected(self.net.inputs(part, self.leans)[0])
            for d in (0, 1):
                if used + len(part) > len(self.table[d]):
                    more = np.empty((max(2 * len(self.table[d]), used + len(part)), 3 * STATE), np.float32)
                    more[:used] = self.table[d][:used]
                    self.table[d] = more
                self.table[d][used : used + len(part)] = rows[d]
            known.update(zip(part, range(used, used + len(part))))

    def windows(self, texts: list[str]):
        """Scores of all overlapping windows, each text's first place among them, and its number of windows."""
        import numpy as np

        docs = [words_of(t) for t in texts]
        self._learn(set().union(*docs))
        get = self.known.__getitem__
        ids = [np.fromiter(map(get, ws), np.int64, len(ws)) for ws in docs]
        counts = [0 if not len(i) else 1 + max(0, -(-(len(i) - WINDOW) // STRIDE)) for i in ids]
        scores = np.zeros(sum(counts), np.float32)
        firsts = np.concatenate(([0], np.cumsum(counts))).astype(int)
        full, places, short = [], [], []
        for k, i in enumerate(ids):
            if len(i) >= WINDOW:
                at = np.minimum(np.arange(counts[k]) * STRIDE, len(i) - WINDOW)
                full.append(i[at[:, None] + np.arange(WINDOW)])
                places.append(firsts[k] + np.arange(counts[k]))
            elif len(i):
                short.append((k, i))
        if full:
            own, place = np.concatenate(full), np.concatenate(places)
            for a in range(0, len(own), 2048):
                part = own[a : a + 2048].T
                scores[place[a : a + 2048]] = self.net.forward(self.table[0][part], self.table[1][part])
        by_size: dict[int, list] = {}
        for k, i in short:
            by_size.setdefault(len(i), []).append((k, i))
        for some in by_size.values():
            part = np.array([i for _, i in some]).T
            scores[[firsts[k] for k, _ in some]] = self.net.forward(self.table[0][part], self.table[1][part])
        return docs, scores, firsts, counts

    def score(self, texts: list[str]) -> list[float]:
        """The highest window score of each text; 0 without words."""
        _, scores, firsts, counts = self.windows(texts)
        return [float(scores[f : f + n].max()) if n else 0.0 for f, n in zip(firsts, counts)]


def train(texts: list[str], labels: list[int], rounds: int = ROUNDS, steps: int = STEPS) -> Network | None:
    """A network for the labels; none where one of them is missing."""
    import numpy as np

    if len(set(labels)) < 2:
        return None
    docs = [words_of(t) for t in texts]
    counts = Counter(w for ws in docs for w in set(ws))
    lean = Leanings(docs, labels)
    lean_word, lean_gram = lean.told()
    leans = [lean.told(f) for f in range(lean.folds)]
    words = {w: i for i, w in enumerate(sorted(sorted(counts), key=lambda w: (-(lean_word.get(w, 0) > 0), -counts[w]))[:VOCABULARY])}
    net = Network(words, lean_word, lean_gram)
    cuts = [[ws[a : a + WINDOW] for a in range(0, max(1, len(ws) - STRIDE), STRIDE)] for ws in docs]
    windows, marks, folds = [], [], []
    known: list[dict[str, float]] = [{} for _ in leans]
    for ws, y, f in zip(cuts, labels, lean.fold_of):
        strength = lambda w: known[f].setdefault(w, max(net.describe(w, leans[f])[2:])) if w not in known[f] else known[f][w]  # noqa: B023, E731
        best = sorted(range(len(ws)), key=lambda i: -sum(strength(w) for w in ws[i]))
        for i in best[:1] if y else {*best[:2], best[-1], best[len(best) // 2]}:
            if ws[i]:
                windows.append(ws[i])
                marks.append(int(y))
                folds.append(f)
    net.fit(windows, marks, steps, 1, folds, leans)
    for k in range(1, rounds):
        by_fold = [Scorer(net, own) for own in leans]
        for f, scorer in enumerate(by_fold):
            mine = [i for i, x in enumerate(lean.fold_of) if x == f]
            for a in range(0, len(mine), 500):
                some = mine[a : a + 500]
                _, scores, firsts, counts_ = scorer.windows([texts[i] for i in some])
                for i, (first, n) in zip(some, zip(firsts, counts_)):
                    ws, y = docs[i], labels[i]
                    for j in np.argsort(-scores[first : first + n], kind="stable")[: 1 if y else 2]:
                        at = max(0, min(int(j) * STRIDE, len(ws) - WINDOW))
                        windows.append(ws[at : at + WINDOW])
                        marks.append(int(y))
                        folds.append(f)
        net.fit(windows, marks, steps, 1 + k, folds, leans)
    net.memo = {}
    return net


def learn(docs: DataFrame, labels: DataFrame, most: int = TRAIN_DOCS) -> Network | None:
    """A network from documents (doc_id, text) with labels (doc_id, toxic).

    Rows with a null label or text don't count; of the others at most ``most``
    are taken, those whose doc_id hashes lowest, and brought to the driver
    whole.  A doc_id with both labels is toxic; of several texts with one
    doc_id the least counts.
    """
    known = columns_apart(labels, "doc_id", "toxic").where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    known = known.orderBy(F.xxhash64(F.lit("sample"), "doc_id"), "doc_id").limit(most)
    rows = columns_apart(docs, "doc_id", "text").where("text is not null").join(F.broadcast(known), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic"))
    rows = sorted(rows.collect(), key=lambda r: r["doc_id"])
    return train([r["text"] for r in rows], [r["toxic"] for r in rows])


def predict(docs: DataFrame, net: Network | None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score, predicted of every row (doc_id, text).

    Null texts, and those without a letter, score 0; so do all where nothing
    was learnt.  Very long texts and words are read whole.  Repeated rows are
    rows of their own.  No rows give none.  Other columns are not looked at,
    whatever their names.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def work(batches):
        import pyarrow as pa

        net = shared.value
        scorer = Scorer(net) if net else None
        for batch in batches:
            for part in (batch.slice(i, 128) for i in range(0, len(batch), 128)):
                texts = [t or "" for t in part.column(1).to_pylist()]
                scores = scorer.score(texts) if scorer else [0.0] * len(texts)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = columns_apart(docs, "doc_id", "text").mapInArrow(work, f"doc_id {kind}, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def detect(docs: DataFrame, labels: DataFrame, most: int = TRAIN_DOCS) -> DataFrame:
    """doc_id, held_out, score, predicted: learnt from the rows not held out, for all.

    A row is held out where crc32 of its doc_id as text leaves 1 by 3; a null
    doc_id is not.  Null and empty texts have a score like any other; very long
    ones are scored in all their windows; repeated rows are rows of their own.
    Without a label to learn from all scores are alike.  No rows give none.
    Columns besides doc_id and text are no inputs, whatever their names.
    """
    out = held_out(F.col("doc_id"), 3, 1)
    net = learn(docs.where(~out), labels.where(~out), most)
    return predict(docs, net).select("doc_id", out.alias("held_out"), "score", "predicted")
