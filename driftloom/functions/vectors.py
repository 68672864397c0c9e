"""Vector and number expressions, built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clip(value: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """``value`` held in [low, high]; null stays null."""
    return F.when(value.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), value)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity in doubles; 0 where a vector is all zero, null where one is null."""
    return ratio(dot(a, b), norm(a) * norm(b), F.lit(0.0))


def ratio(top: Column, bottom: Column, otherwise: Column | None = None) -> Column:
    """top / bottom; ``otherwise`` (null) where bottom is 0, null where one is null."""
    return F.when(top.isNull() | bottom.isNull(), F.lit(None)).otherwise(F.coalesce(F.try_divide(top, bottom), F.lit(None) if otherwise is None else otherwise))


def mean_vector(vectors: Column) -> Column:
    """The mean of an array of vectors of one length."""
    first = F.transform(F.get(vectors, 0), lambda x: F.lit(0.0))
    total = F.aggregate(vectors, first, lambda s, v: F.zip_with(s, v, lambda x, y: x + y.cast("double")))
    return F.transform(total, lambda x: x / F.size(vectors))


def softmax(logits: Column) -> Column:
    """Shares of an array of logits."""
    top = F.array_max(logits)
    return F.transform(F.transform(logits, lambda x: F.exp(x - top)), lambda e: e / F.aggregate(F.transform(logits, lambda x: F.exp(x - top)), F.lit(0.0), lambda s, x: s + x))


def entailment_label(e: Column, n: Column, c: Column) -> Column:
    """The largest of the three; of equals the first in this order."""
    return F.when((e >= n) & (e >= c), "entailment").when(n >= c, "neutral").otherwise("contradiction")


def mean_present(*values: Column) -> Column:
    """Mean of those that are not null; null if none is."""
    top, n = F.lit(0.0), F.lit(0)
    for v in values:
        top, n = top + F.coalesce(v, F.lit(0.0)), n + v.isNotNull().cast("int")
    return F.try_divide(top, n)


def weighted_mean(*pairs: tuple[Column, float]) -> Column:
    """Weighted mean of the values that are not null, over their weights; null if none weighs."""
    top, bottom = F.lit(0.0), F.lit(0.0)
    for value, weight in pairs:
        if weight > 0:
            top = top + F.coalesce(value * F.lit(float(weight)), F.lit(0.0))
            bottom = bottom + F.when(value.isNotNull(), F.lit(float(weight))).otherwise(F.lit(0.0))
    return F.try_divide(top, bottom)
