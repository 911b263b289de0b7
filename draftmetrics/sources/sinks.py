"""Sinks: CSV with a byte order mark, Parquet, JSON totals, dead letters."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BOM = "﻿"


def write_csv(df: DataFrame, path: str, bom: bool = True, one_file: bool = False) -> None:
    """CSV with a header; arrays are joined by " | ".  Files are committed as a whole.

    ``one_file`` sorts nothing and brings all rows to one task: for small reports only.
    """
    columns = [F.array_join(F.col(f"`{c}`").cast("array<string>"), " | ").alias(c) if t.startswith("array") else F.col(f"`{c}`") for c, t in df.dtypes]
    flat = df.select(*columns)
    if bom and flat.columns:
        flat = flat.withColumnRenamed(flat.columns[0], BOM + flat.columns[0])
    files = flat.coalesce(1) if one_file else flat
    replace(df, path, lambda new: files.write.option("header", True).option("encoding", "UTF-8").csv(new))


def replace(df: DataFrame, path: str, write: Callable[[str], None]) -> None:
    """Write a table beside ``path``, then let it take the old one's place by renaming: a failed write leaves the old one."""
    jvm, conf = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    new, old = (f"{path.rstrip('/')}._{kind}-{uuid.uuid4().hex}" for kind in ("new", "old"))
    place = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    fs = place(path).getFileSystem(conf)
    try:
        write(new)
    except BaseException:
        fs.delete(place(new), True)
        raise
    if fs.exists(place(path)):
        if not fs.rename(place(path), place(old)):
            raise OSError(f"{path} can't be renamed")
    if not fs.rename(place(new), place(path)):
        if fs.exists(place(old)):
            fs.rename(place(old), place(path))
        raise OSError(f"{new} can't be renamed")
    fs.delete(place(old), True)


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Replace (or, with another mode, add to) a Parquet table."""
    if mode == "overwrite":
        replace(df, path, lambda new: df.write.parquet(new))
    else:
        df.write.mode(mode).parquet(path)


def write_scores(scores: DataFrame, path: str, **facts: str | int | float) -> None:
    """Permutation scores with the facts about them (metric, permutations, sizes) in columns of their own."""
    for name, value in facts.items():
        scores = scores.withColumn(name, F.lit(value))
    write_parquet(scores, path)


def report_lines(results: DataFrame, by: str = "model") -> DataFrame:
    """(line): one printable line for each row of scores."""
    numbers = [F.concat(F.lit(f", {c} "), F.format_number(F.col(c).cast("double"), 3)) for c, t in results.dtypes if t == "double"]
    counts = [F.concat(F.lit(f", {c} "), F.col(c).cast("string")) for c in ("tn", "fp", "fn", "tp") if c in results.columns]
    return results.select(F.concat(F.lit("=== "), F.col(by), F.lit(" ==="), *numbers, *counts).alias("line"))


def totals_json(df: DataFrame, columns: list[str]) -> DataFrame:
    """(json): one object of column totals, in the order given."""
    return df.agg(F.to_json(F.struct(*[F.sum(f"`{c}`").alias(c) for c in columns])).alias("json"))


def split_failures(df: DataFrame, error_col: str = "_error") -> tuple[DataFrame, DataFrame]:
    """Good rows (without the error column) and dead letters (with the time of the split)."""
    good = df.filter(F.col(error_col).isNull()).drop(error_col)
    return good, df.filter(F.col(error_col).isNotNull()).withColumn("failed_at", F.current_timestamp())


def append_failures(failures: DataFrame, path: str) -> None:
    """Add dead letters (with their tracebacks) to the log table; earlier ones stay."""
    stamped = failures if "failed_at" in failures.columns else failures.withColumn("failed_at", F.current_timestamp())
    stamped.write.mode("append").parquet(path)


def empty_extractions(df: DataFrame, array_col: str) -> DataFrame:
    """Rows whose extraction found nothing, for inspection."""
    return df.filter(F.coalesce(F.size(array_col), F.lit(0)) <= 0)
