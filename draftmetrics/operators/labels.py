"""Judged labels: JSON answers parsed, flattened, pivoted and appended."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: An answer: dimensions with name, score and rationale, an overall score and notes.
ANSWER = "struct<dimensions: array<struct<name: string, score: double, rationale: string>>, overall_score: double, notes: string>"


def parsed_block(raw: Column) -> Column:
    """The answer itself if it is JSON, else the largest block in braces if that is; null otherwise.  A block is looked for only where that failed."""
    return F.coalesce(F.try_parse_json(raw), F.try_parse_json(F.nullif(F.regexp_extract(raw, r"(?s)\{.*\}", 0), F.lit(""))))


def parse_answers(df: DataFrame, raw_col: str, schema: str = ANSWER) -> DataFrame:
    """``df`` with ``answer`` (null where there is no JSON) and ``_error``; the text is parsed once."""
    found = df.withColumn("_block", parsed_block(F.col(raw_col)))
    return found.select(*df.columns, F.try_variant_get("_block", "$", schema).alias("answer"), F.when(F.col("_block").isNull(), "no JSON in the answer").alias("_error"))


def flatten_answers(parsed: DataFrame, key: str) -> DataFrame:
    """(key, dim, score, rationale): one row for each dimension; of repeated ones the last counts."""
    long = parsed.filter("answer IS NOT NULL").select(key, F.posexplode("answer.dimensions").alias("pos", "d"))
    named = long.withColumn("dim", F.replace(F.col("d.name"), F.lit(" "), F.lit("_")))
    return named.groupBy(key, "dim").agg(F.max_by("d.score", "pos").alias("score"), F.max_by("d.rationale", "pos").alias("rationale"))


def unknown_dimensions(long: DataFrame, dims: list[str]) -> DataFrame:
    """Rows of ``flatten_answers`` whose dimension is not named: misspelt ones, to be looked at."""
    return long.filter(F.col("dim").isNull() | ~F.col("dim").isin(dims))


def pivot_answers(long: DataFrame, key: str, dims: list[str]) -> DataFrame:
    """One row for each key: ``score_<dim>`` and ``rationale_<dim>`` of the dimensions named; ``unknown_dimensions`` has the others."""
    wide = long.groupBy(key)
    aggs = []
    for d in dims:
        here = F.col("dim") == d
        aggs += [F.max(F.when(here, F.col("score"))).alias(f"score_{d}"), F.max(F.when(here, F.col("rationale"))).alias(f"rationale_{d}")]
    return wide.agg(*aggs)


def append_new(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``old`` and the rows of ``new`` whose key it lacks; columns are united, the first of equal new keys wins by content."""
    fresh = new.join(old.select(key).distinct(), key, "left_anti").dropDuplicates([key])
    return old.unionByName(fresh, allowMissingColumns=True)
