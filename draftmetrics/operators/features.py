"""Relational assembly of the feature matrix."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Vocabularies of at most so many words are broadcast; larger ones meet the tokens in a shuffled join.
BROADCAST_ROWS = 200_000


def checked_broadcast(side: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``side`` with a broadcast hint if it has at most ``limit`` rows; without it the planner decides."""
    return F.broadcast(side) if side.limit(limit + 1).count() <= limit else side


def natural_join(a: DataFrame, b: DataFrame, null_safe: bool = False) -> DataFrame:
    """Inner join on all shared columns; ``null_safe`` lets null keys meet."""
    shared = sorted(set(a.columns) & set(b.columns))
    if not shared:
        raise ValueError("no shared column")
    if not null_safe:
        return a.join(b, shared)
    right = b.select(*[F.col(c).alias(f"_{c}") if c in shared else F.col(c) for c in b.columns])
    cond = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in shared])
    return a.join(right, cond).drop(*[f"_{c}" for c in shared])


def assemble(parts: list[DataFrame]) -> DataFrame:
    """A chain of natural joins; parts with one key need one exchange each at most."""
    return reduce(natural_join, parts)


def without(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not listed (null keys stay)."""
    return df.join(keys.select(key).distinct(), key, "left_anti")


def only(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose key is listed."""
    return df.join(keys.select(key).distinct(), key, "left_semi")


def coverage(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """(total, matched, unmatched) rows."""
    flagged = df.select(key).join(keys.select(key).distinct().withColumn("hit", F.lit(1)), key, "left")
    return flagged.agg(F.count("*").alias("total"), F.count("hit").alias("matched"), F.count_if(F.col("hit").isNull()).alias("unmatched"))


def patched(df: DataFrame, patches: DataFrame, key: str, column: str) -> DataFrame:
    """Values of ``column`` replaced where the patch table (key, column) has one."""
    side = patches.select(key, F.col(column).alias("_patch"))
    return df.join(side, key, "left").withColumn(column, F.coalesce("_patch", column)).drop("_patch")


def term_of(day: Column, boundary: str, before: int, since: int) -> Column:
    """The term of a date: one before the boundary, the other from it on."""
    return F.when(day < F.lit(boundary).cast("date"), before).when(day.isNotNull(), since)


def lowest(df: DataFrame, score: str, key: str, n: int) -> DataFrame:
    """The n lowest-scored rows; ties by key."""
    return df.orderBy(F.col(score).asc_nulls_last(), key).limit(n)


def first_position(df: DataFrame, id_col: str, order_col: str, wanted) -> DataFrame:
    """Rows from the first occurrence of an id on are flagged ``later``; none are if it does not occur."""
    at = df.filter(F.col(id_col) == wanted).agg(F.min(order_col).alias("at"))
    return df.crossJoin(F.broadcast(at)).withColumn("later", F.coalesce(F.col(order_col) >= F.col("at"), F.lit(False))).drop("at")  # ``at`` is one row
