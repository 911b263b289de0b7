"""Descriptive statistics, each from one pass over the table."""

from __future__ import annotations

from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from draftmetrics.session import scratch_table


def null_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, n_null, n_rows)."""
    counted = df.agg(F.count("*").alias("_n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return counted.unpivot("_n", columns, "column", "n_null").select("column", "n_null", F.col("_n").alias("n_rows"))


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, n, mean, std, min, q25, q50, q75, max): sample deviation, exact interpolated quantiles."""

    def stats(c: str) -> Column:
        x = F.col(c).cast("double")
        return F.struct(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"))

    df = scratch_table(df.select(*columns))  # read for the quantiles as well
    one = df.agg(*[stats(c).alias(c) for c in columns]).unpivot([], columns, "column", "s")
    joined = one.join(quantiles(df, columns, [0.25, 0.5, 0.75]), "column", "left")
    return joined.select("column", "s.n", "s.mean", "s.std", "s.min", F.col("q")[0].alias("q25"), F.col("q")[1].alias("q50"), F.col("q")[2].alias("q75"), "s.max")


def quantiles(df: DataFrame, columns: list[str], shares: list[float]) -> DataFrame:
    """(column, q): exact quantiles, interpolated between neighbours, of known values.

    Distinct values are counted, dealt by range and ranked by running sums within their range
    and over ranges, so no task holds all values of a column.
    """
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns])).alias("x")).select("x.*").filter("value IS NOT NULL")
    counted = long.groupBy("column", "value").agg(F.count("*").alias("n"))
    dealt = scratch_table(counted.repartitionByRange("column", "value").withColumn("part", F.spark_partition_id()))
    before = Window.partitionBy("column").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    sums = dealt.groupBy("column", "part").agg(F.sum("n").alias("n"))
    starts = sums.select("column", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"), F.sum("n").over(Window.partitionBy("column")).alias("total"))
    inside = Window.partitionBy("column", "part").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.withColumn("first", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(starts, ["column", "part"]).withColumn("first", F.col("first") + F.col("start"))

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("first") <= rank) & (rank < F.col("first") + F.col("n")), F.col("value")))

    place = [(F.col("total") - 1) * s for s in shares]
    found = placed.groupBy("column", "total").agg(*[at(g(p)).alias(f"{n}{k}") for k, p in enumerate(place) for n, g in (("l", F.floor), ("h", F.ceil))])
    q = [F.when(F.ceil(p) == F.floor(p), F.col(f"l{k}")).otherwise((F.ceil(p) - p) * F.col(f"l{k}") + (p - F.floor(p)) * F.col(f"h{k}")) for k, p in enumerate(place)]
    return found.select("column", F.array(*q).alias("q"))


def info(df: DataFrame) -> DataFrame:
    """(position, column, dtype, n_rows, n_known) of every column."""
    counted = null_profile(df, df.columns)
    kinds = df.sparkSession.createDataFrame([(k, c, t) for k, (c, t) in enumerate(df.dtypes)], "position int, column string, dtype string")
    return kinds.join(counted, "column").select("position", "column", "dtype", "n_rows", (F.col("n_rows") - F.col("n_null")).alias("n_known"))


def _correlation(a: Column, b: Column) -> Column:
    x, y = F.when(b.isNotNull(), a.cast("double")), F.when(a.isNotNull(), b.cast("double"))
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def corr_matrix(df: DataFrame, columns: list[str], by: str | None = None) -> DataFrame:
    """(a, b, r) for every ordered pair: Pearson over rows where both are known; null for a constant column."""
    pairs = list(combinations_with_replacement(columns, 2))
    grouped = df.groupBy(by) if by else df.groupBy()
    one = grouped.agg(*[_correlation(F.col(a), F.col(b)).alias(f"{i}") for i, (a, b) in enumerate(pairs)])
    both = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{i}`").alias("r")) for i, (x, y) in enumerate(pairs) for a, b in dict.fromkeys([(x, y), (y, x)])]
    return one.select(*([by] if by else []), F.explode(F.array(*both)).alias("p")).select(*([by] if by else []), "p.*")


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """(value, n) of known values, most frequent first."""
    return df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value")


def histogram(df: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """(bin, low, high, n): equal widths over the range, the last bin closed; empty bins are given."""
    x = F.col(column).cast("double")
    ends = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi")).filter("lo IS NOT NULL")
    width = (F.col("hi") - F.col("lo")) / bins
    at = F.when(F.col("hi") == F.col("lo"), 0).otherwise(F.least(F.floor((x - F.col("lo")) / width), F.lit(bins - 1)))
    counted = df.filter(x.isNotNull()).crossJoin(F.broadcast(ends)).groupBy(at.cast("long").alias("bin")).agg(F.count("*").alias("n"))  # ``ends`` is one row
    grid = ends.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long"))).alias("bin"), "lo", width.alias("w"))
    return grid.join(counted, "bin", "left").select("bin", (F.col("lo") + F.col("bin") * F.col("w")).alias("low"), (F.col("lo") + (F.col("bin") + 1) * F.col("w")).alias("high"), F.coalesce("n", F.lit(0)).alias("n"))
