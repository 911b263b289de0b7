"""A sentence encoder without a model file: weighted sets of hashed character n-grams.

A text is the set of its n-grams' numbers (a polynomial of their code points, modulo
``DIMENSIONS``), each weighted by how rare it is among the sentences that the encoder was
fitted on; two texts are as similar as the cosine of their vectors.  Numbers and weights are
column expressions, so sentences are compared in the JVM without a shuffle; only the fit,
one count for each number, is an aggregate, and its result has ``DIMENSIONS`` rows at most.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A prime below 2^16: vectors and weights stay small however large the corpus is.
DIMENSIONS = 65_521
#: Lengths of n-grams; shorter texts have their longest n-gram.
SIZES = (2, 3)
BASE = 131


def clean(text: Column) -> Column:
    """In lower case and with collapsed blanks."""
    return F.lower(F.regexp_replace(F.regexp_replace(text, r"(?U)\s+", " "), "^ | $", ""))


def buckets(text: Column, sizes: Sequence[int] = SIZES, dimensions: int = DIMENSIONS) -> Column:
    """The distinct numbers of a text's n-grams, in lower case and with collapsed blanks; null for null."""
    given = clean(text)
    points = F.transform(F.split(given, ""), lambda c: F.ascii(c).cast("long"))

    def grams(cp: Column, n: int) -> Column:
        last = F.size(cp) - n + 1
        # the polynomial at once: it stays below 2^63 for the sizes in use
        number = lambda x, i: F.pmod(sum((F.get(cp, i + k) * BASE ** (n - 1 - k) for k in range(1, n)), x * BASE ** (n - 1) + n * BASE**n), F.lit(dimensions))
        return F.when(last >= 1, F.transform(F.slice(cp, 1, F.greatest(last, F.lit(1))), number)).otherwise(F.array().cast("array<bigint>"))

    def of(cp: Column) -> Column:
        short = F.array(F.aggregate(cp, F.lit(0).cast("long"), lambda acc, x: F.pmod(acc * BASE + x, F.lit(dimensions))))
        return F.when(F.size(cp) >= min(sizes), F.array_distinct(F.concat(*[grams(cp, n) for n in sizes]))).otherwise(short)

    # one element, so that the code points are made once
    return F.when(given != "", F.transform(F.array(points), of)[0]).when(given == "", F.array().cast("array<bigint>"))


def numbers_of(texts: pa.Array, sizes: Sequence[int] = SIZES, dimensions: int = DIMENSIONS) -> pa.Array:
    """The sorted distinct numbers of the n-grams of many clean texts at once; null for null."""
    given = pc.fill_null(texts, "")
    length = pc.utf8_length(given).to_numpy(zero_copy_only=False).astype(np.int64)
    cp = np.frombuffer("".join(given.to_pylist()).encode("utf-32-le"), np.uint32).astype(np.int64)
    owner, place = np.repeat(np.arange(len(length)), length), np.arange(len(cp)) - np.repeat(np.cumsum(length) - length, length)
    left, found = np.repeat(length, length) - place, []
    for n in sizes:
        at = np.flatnonzero(left >= n)
        number = sum((cp[at + k] * BASE ** (n - 1 - k) for k in range(n)), np.full(len(at), n * BASE**n)) % dimensions
        found.append(owner[at] * dimensions + number)
    for at in np.flatnonzero((place == 0) & (left < min(sizes))):  # a text that is too short for any
        number = 0
        for x in cp[at : at + left[at]].tolist():
            number = (number * BASE + x) % dimensions
        found.append(np.array([owner[at] * dimensions + number]))
    every = np.sort(np.concatenate(found))
    every = every[np.append(True, every[1:] != every[:-1])] if len(every) else every
    ends = np.cumsum(np.bincount(every // dimensions, minlength=len(length)))
    return pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(every % dimensions, pa.int32()), mask=pc.is_null(texts))


def many_buckets(text: Column) -> Column:
    """``buckets`` as array<int> in any order, for very many texts: worked out for a batch at once in Python workers, as functions over arrays are interpreted."""

    @F.arrow_udf("array<int>")
    def numbers(texts: pa.Array) -> pa.Array:
        return numbers_of(texts)

    return numbers(clean(text))


def plain_buckets(text: str, sizes: Sequence[int] = SIZES, dimensions: int = DIMENSIONS) -> set[int]:
    """``buckets`` of one text in Python."""
    cp = [ord(c) for c in " ".join(text.split()).lower()]

    def number(part: list[int], start: int) -> int:
        for x in part:
            start = (start * BASE + x) % dimensions
        return start

    if 0 < len(cp) < min(sizes):
        return {number(cp, 0)}
    return {number(cp[i : i + n], n) for n in sizes for i in range(len(cp) - n + 1)}


def fit(sentences: DataFrame, text_col: str, sizes: Sequence[int] = SIZES, dimensions: int = DIMENSIONS) -> DataFrame:
    """One row (``weights``): for each number ln((sentences + 1) / (sentences with it + 1)), the usual smooth inverse frequency."""
    sets = sentences.select(buckets(F.col(text_col), sizes, dimensions).alias("b")).filter("b IS NOT NULL")
    # -1 is in every sentence, so one aggregate counts them as well
    seen = sets.select(F.explode(F.concat("b", F.array(F.lit(-1).cast("long")))).alias("k")).groupBy("k").agg(F.count("*").alias("df"))
    every = sentences.sparkSession.range(-1, dimensions).withColumnRenamed("id", "k")
    # ``dimensions`` rows, whatever the corpus
    whole = every.join(seen, "k", "left").agg(F.array_sort(F.collect_list(F.struct("k", F.coalesce("df", F.lit(0)).alias("df")))).alias("dfs"))
    n = F.element_at("dfs", 1)["df"]
    return whole.select(F.transform(F.slice("dfs", 2, dimensions), lambda x: F.log((n + 1) / (x["df"] + 1))).alias("weights"))


def mass(numbers: Column, weights: Column) -> Column:
    """The squared length of a set's vector."""
    return F.aggregate(numbers, F.lit(0.0), lambda acc, k: acc + F.get(weights, k) * F.get(weights, k))


def similarity(a: Column, b: Column, weights: Column) -> Column:
    """The cosine of two sets of numbers; 0 where one has no weight."""
    return F.coalesce(F.try_divide(mass(F.array_intersect(a, b), weights), F.sqrt(mass(a, weights)) * F.sqrt(mass(b, weights))), F.lit(0.0))


def overlap(a: Column, b: Column) -> Column:
    """The cosine of two sets of numbers of equal weight; 0 where one is empty."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.sqrt(F.size(a).cast("double") * F.size(b))), F.lit(0.0))


def with_similarity(rows: DataFrame, text_col: str, exemplars: Sequence[str], model: DataFrame, name: str = "similarity") -> DataFrame:
    """``rows`` with the greatest similarity to one of a few exemplar texts; null for null."""
    fixed = [F.array(*[F.lit(k).cast("long") for k in sorted(plain_buckets(e))]).cast("array<bigint>") for e in exemplars]
    side = model.select(F.col("weights").alias("__w"), F.array(*[F.sqrt(mass(e, F.col("weights"))) for e in fixed]).alias("__e"))
    given = rows.withColumn("__b", buckets(F.col(text_col))).join(F.broadcast(side))  # one row of DIMENSIONS numbers
    given = given.withColumn("__m", F.sqrt(mass(F.col("__b"), F.col("__w"))))
    best = [F.coalesce(F.try_divide(mass(F.array_intersect("__b", e), F.col("__w")), F.col("__m") * F.col("__e")[k]), F.lit(0.0)) for k, e in enumerate(fixed)]
    return given.withColumn(name, F.when(F.col("__b").isNotNull(), F.greatest(*best) if len(best) > 1 else best[0])).drop("__b", "__w", "__e", "__m")


class NgramEncoder:
    """The same vectors for interfaces that take dense arrays: folded to ``width`` places, of length 1."""

    def __init__(self, weights: Sequence[float] | None = None, width: int = 512):
        self.weights, self.width = weights, width

    def encode(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.width))
        for row, text in zip(out, texts):
            for k in plain_buckets(text):
                row[k % self.width] += 1.0 if self.weights is None else self.weights[k]
            length = math.sqrt(float(row @ row))
            if length:
                row /= length
        return out
