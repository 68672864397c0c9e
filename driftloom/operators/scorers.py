"""Scorers: model-free defaults as expressions, and adapters for models.

An adapter runs a model on Arrow batches.  An error is returned as a value, so
one run's failure fails neither its task nor other runs: the batch is tried
again row by row, and rows that fail carry the message.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from hashlib import sha256

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import let, word_set, words
from ..sources.shared import written

EMBEDDED = "vector array<double>, error string"
JUDGED = "entailment double, neutral double, contradiction double, error string"


def overlap(premise_words: Column, hypothesis_words: Column) -> Column:
    """Struct of entailment, neutral, contradiction by the share of the hypothesis' words in the premise; null where one is null."""
    share = F.size(F.array_intersect(premise_words, hypothesis_words)) / F.greatest(F.size(hypothesis_words), F.lit(1))
    told = let(F.greatest(F.lit(0.05), F.least(F.lit(0.95), share)), lambda e: F.struct(e.alias("entailment"), ((1 - e) * 0.7).alias("neutral"), ((1 - e) * 0.3).alias("contradiction")))
    return F.when(premise_words.isNotNull() & hypothesis_words.isNotNull(), told)


def overlap_entailment(premise: Column, hypothesis: Column) -> Column:
    """``overlap`` of two texts."""
    return overlap(word_set(premise), word_set(hypothesis))


def bucket_vector(text: Column, buckets: int = 128) -> Column:
    """Dense counts of words by their crc32; for small vectors and hand checks."""
    found = F.transform(words(text), lambda w: F.crc32(w) % buckets)
    return F.transform(F.sequence(F.lit(0), F.lit(buckets - 1)), lambda b: F.size(F.filter(found, lambda x: x == b)).cast("double"))


def _guarded(call: Callable, rows: list, empty):
    """Results and errors of ``call(rows)``, one by one where the whole fails."""
    try:
        return list(call(rows)), [None] * len(rows)
    except Exception:
        out, errors = [], []
        for r in rows:
            try:
                out.append(list(call([r]))[0])
                errors.append(None)
            except Exception as e:
                out.append(empty)
                errors.append(f"{type(e).__name__}: {e}")
        return out, errors


class ScoreTable:
    """Scores of a model by the digest of what it scored, in a folder that executors share.

    Only what the table lacks is scored, and added to it as a part of its own;
    a part counts once it is whole.  What failed is not kept, so it is tried
    again.  Each model has a folder of its own; a row that two analyses added
    at the same time counts once.
    """

    def __init__(self, spark: SparkSession, folder: str, model: str):
        self.spark, self.path = spark, f"{folder}/model={sha256(model.encode()).hexdigest()}"

    def filled(self, rows: DataFrame, score: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """``score(rows)`` for distinct ``rows``, which ``score`` returns with what it adds and an error."""
        keys = rows.columns
        part = lambda c: F.concat(F.length(c).cast("string"), F.lit(":"), F.col(c))
        digest = F.sha2(F.concat(*[part(c) for c in keys]), 256).alias("_digest")
        asked = written(rows.select(*keys, digest), "asked")
        known = self.known()
        fresh = asked if known is None else asked.join(known.select("_digest"), "_digest", "left_anti")
        fresh = written(score(fresh.select(*keys)).select("*", digest), "scores")
        added = [c for c in fresh.columns if c not in (*keys, "_digest")]
        good = fresh.where("error is null").select("_digest", *added)
        if good.limit(1).count():
            good.write.parquet(f"{self.path}/{uuid.uuid4().hex}")
        failed = fresh.where("error is not null").select(*keys, *added)
        known = self.known()
        if known is None:
            return failed
        return asked.join(known.dropDuplicates(["_digest"]), "_digest").select(*keys, *added).unionByName(failed)

    def known(self) -> DataFrame | None:
        """All parts that are whole, each by its name: plans with different parts must not pass for the same scan."""
        files = self.spark._jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())
        at = lambda *p: self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.path, *p)))
        if not files.exists(at()):
            return None
        names = sorted(s.getPath().getName() for s in files.listStatus(at()))
        whole = [f"{self.path}/{n}" for n in names if files.exists(at(n, "_SUCCESS"))]
        return self.spark.read.option("basePath", self.path).parquet(*whole) if whole else None


def embed_with(df: DataFrame, text: str, load: Callable[[], Callable[[Sequence[str]], Sequence[Sequence[float]]]], kept: ScoreTable | None = None) -> DataFrame:
    """``df`` with vector and error; each distinct text is embedded once, and never again if it is in ``kept``.

    ``load`` makes the embedder, once a worker, where there is something to embed.
    """

    def work(batches):
        import pyarrow as pa

        model = None
        for batch in batches:
            rows = batch.column(0).to_pylist()

            def call(some):
                nonlocal model
                model = model or load()
                return [[float(x) for x in v] for v in model(some)]

            vectors, errors = _guarded(call, rows, None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(vectors, pa.list_(pa.float64())), pa.array(errors, pa.string())], ["_text", "vector", "error"])

    texts = df.select(F.col(text).alias("_text")).where("_text is not null").distinct()
    score = lambda rows: rows.mapInArrow(work, f"_text string, {EMBEDDED}")
    done = score(texts) if kept is None else kept.filled(texts, score)
    return df.join(done, df[text] == done["_text"], "left").drop("_text")


def judge_with(df: DataFrame, premise: str, hypothesis: str, load: Callable[[], Callable[[Sequence[tuple[str, str]]], Sequence[Sequence[float]]]], kept: ScoreTable | None = None) -> DataFrame:
    """``df`` with entailment, neutral, contradiction and error from a model of logits or shares.

    ``load`` makes a function from pairs to (entailment, neutral, contradiction).
    Each distinct pair is judged once, and never again if it is in ``kept``.
    """

    def work(batches):
        import pyarrow as pa

        model = None
        for batch in batches:
            rows = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))

            def call(some):
                nonlocal model
                model = model or load()
                return [tuple(map(float, x)) for x in model(some)]

            found, errors = _guarded(call, rows, (None, None, None))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array([x[i] for x in found], pa.float64()) for i in range(3)], pa.array(errors, pa.string())], ["_p", "_h", "entailment", "neutral", "contradiction", "error"])

    pairs = df.select(F.col(premise).alias("_p"), F.col(hypothesis).alias("_h")).where("_p is not null and _h is not null").distinct()
    score = lambda rows: rows.mapInArrow(work, f"_p string, _h string, {JUDGED}")
    done = score(pairs) if kept is None else kept.filled(pairs, score)
    return df.join(done, (df[premise] == done["_p"]) & (df[hypothesis] == done["_h"]), "left").drop("_p", "_h")


def sentence_model(name: str, device: str | None = None):
    """A loader of a sentence encoder, for ``embed_with``; needs its library."""

    def load():
        from sentence_transformers import SentenceTransformer

        return SentenceTransformer(name, device=device).encode

    return load


def pair_model(name: str, device: str | None = None):
    """A loader of a cross-encoder for three labels, for ``judge_with``; needs its library."""

    def load():
        import numpy as np
        from sentence_transformers import CrossEncoder

        model = CrossEncoder(name, device=device)
        named = getattr(model.model.config, "id2label", {}) or {}
        order = [str(named[i]).lower() for i in sorted(named)] if len(named) == 3 else []
        if sorted(order) != ["contradiction", "entailment", "neutral"]:
            order = ["contradiction", "entailment", "neutral"]

        def judge(pairs):
            logits = np.asarray(model.predict(list(pairs)), float)
            shares = np.exp(logits - logits.max(1, keepdims=True))
            shares /= shares.sum(1, keepdims=True)
            return shares[:, [order.index(x) for x in ("entailment", "neutral", "contradiction")]]

        return judge

    return load
