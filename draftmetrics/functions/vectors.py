"""Vector functions on arrays of numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    pairs = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda acc, x: acc + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null where a vector has no length."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def max_cosine(a: Column, exemplars: list[list[float]]) -> Column:
    """The greatest similarity with a few fixed vectors."""
    return F.greatest(*[cosine(a, F.array(*[F.lit(float(x)) for x in e])) for e in exemplars]) if len(exemplars) > 1 else cosine(a, F.array(*[F.lit(float(x)) for x in exemplars[0]]))
