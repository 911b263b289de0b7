"""Files: id lists, typed tables, text folders with an encoding fallback, lexicons."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType
from pyspark.sql import types as T

from draftmetrics.functions.scalars import file_id, grade_number
from draftmetrics.functions.text import trim_blanks


def id_list(spark: SparkSession, path: str) -> DataFrame:
    """(value): a text file's lines, trimmed, without blank ones."""
    return clean_lines(spark.read.text(path), "value")


def clean_lines(df: DataFrame, column: str) -> DataFrame:
    return df.select(trim_blanks(F.col(column)).alias("value")).filter("value <> ''")


def read_table(spark: SparkSession, path: str, schema: str | T.StructType, encoding: str = "UTF-8") -> DataFrame:
    """A CSV file with a header and a declared schema; a byte order mark before the first name is ignored."""
    return spark.read.schema(schema).option("header", True).option("encoding", encoding).option("mode", "FAILFAST").option("enforceSchema", True).csv(path)


@F.pandas_udf(StringType())
def _decode_fallback(content: pd.Series) -> pd.Series:
    return content.map(lambda b: None if b is None else bytes(b).decode("cp949", "ignore"))


def _csv_rows(content: bytes, names: list[str]) -> Iterator[list[str | None]]:
    """The named columns of one file in UTF-8 (a byte order mark is ignored), or else in cp949; empty fields are null."""
    try:
        text = content.decode("utf-8-sig")
    except UnicodeDecodeError:
        text = content.decode("cp949")
    rows = csv.reader(io.StringIO(text, newline=""), strict=True)
    header = next(rows, None)
    if header is None:
        return
    if missing := [n for n in names if n not in header]:
        raise ValueError(f"no column {', '.join(missing)}")
    at = [header.index(n) for n in names]
    for row in rows:
        if row:
            if len(row) > len(header):
                raise ValueError(f"too many fields: {row}")
            yield [row[k] or None if k < len(row) else None for k in at]


def read_table_any(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """CSV tables whose files are each in UTF-8 or else in cp949 (which Spark's reader doesn't know).

    Columns are found by name in each file's header; quoted fields may hold line breaks.  A
    file is parsed as a whole in one task; large UTF-8 tables are for ``read_table``.
    """
    kind = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    names = kind.names

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for content in frame["content"]:
                rows = list(_csv_rows(bytes(content), names))
                yield pd.DataFrame({"row": pd.Series(rows, dtype=object)})

    rows = spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "row array<string>")
    return rows.select(*[F.col("row")[k].cast(f.dataType).alias(f.name) for k, f in enumerate(kind.fields)])


def text_folder(spark: SparkSession, path: str, pattern: str = "*.txt") -> DataFrame:
    """(file, doc, text): whole files; bytes that are not UTF-8 are read as cp949."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    as_text = F.col("content").cast("string")
    text = F.when(F.is_valid_utf8(as_text), F.regexp_replace(as_text, "^﻿", "")).otherwise(_decode_fallback("content"))
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    return raw.select(name.alias("file"), file_id(F.col("path")).alias("doc"), text.alias("text"))


def sorted_files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """(path, length, content) in path order."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "length", "content").orderBy("path")


def clean_lexicon(raw: DataFrame, word: str, pos: str, gloss: str, grade: str, order: str) -> DataFrame:
    """(word, pos, gloss, grade, sense_ord): grades as numbers; rows that lack any of the four go."""
    typed = raw.select(F.col(word).alias("word"), F.col(pos).alias("pos"), F.col(gloss).alias("gloss"), grade_number(F.col(grade)).alias("grade"), F.col(order).alias("sense_ord"))
    return typed.na.drop(subset=["word", "pos", "gloss", "grade"])
