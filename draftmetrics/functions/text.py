"""Text functions as column expressions: sentences, words, white space, phrases."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Stands for a full stop beside a digit while sentences are cut.
MASK = "∙"
BLANKS = " \t\n\r"


def trim_blanks(c: Column) -> Column:
    """Without blanks of any kind at both ends; the end is searched for only where the last character is a blank."""
    begun = without_leading_blanks(c)
    return F.when(F.substring(c, -1, 1).rlike(r"(?U)\s"), F.regexp_replace(begun, r"(?U)\s+$", "")).otherwise(begun)


def without_leading_blanks(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+", "")


def lines(text: Column) -> Column:
    """Non-blank lines, trimmed; any kind of line break counts."""
    split = F.split(F.regexp_replace(text, r"\r\n?", "\n"), "\n")
    return F.filter(F.transform(split, trim_blanks), lambda x: x != "")


def mask_digit_dots(line: Column) -> Column:
    """Full stops that belong to a number (3.14, 2016. 01., "10. )") replaced by a mask; the full stop is searched for first, as a digit before it is dearer to see."""
    inner = F.regexp_replace(line, r"(?U)\.(?<=\d\.)(?=\s*\d)", MASK)
    return F.regexp_replace(inner, r"(?U)\.(?<=\d\.)(?=\s*$|\s+[)\]])", MASK)


def line_sentences(line: Column, letters: str, shortest: int = 7) -> Column:
    """Sentences of one line: cut after each full stop, long enough, ending in a letter and a full stop."""
    parts = F.split(mask_digit_dots(line), r"\.", -1)
    closed = F.slice(parts, 1, F.size(parts) - 1)  # what follows the last full stop is dropped
    whole = F.transform(closed, lambda p: without_leading_blanks(F.concat(p, F.lit("."))))
    return F.filter(whole, lambda s: (F.length(s) >= shortest) & s.rlike(rf"[{letters}]\.$"))


def sentences(text: Column, letters: str) -> Column:
    """Sentences within lines."""
    return F.flatten(F.transform(lines(text), lambda x: line_sentences(x, letters)))


def loose_sentences(text: Column, shortest: int = 6) -> Column:
    """Sentences across lines: anything up to a full stop, trimmed and long enough."""
    parts = F.split(text, r"\.", -1)
    closed = F.filter(F.slice(parts, 1, F.size(parts) - 1), lambda p: p != "")  # what follows the last full stop is dropped
    return F.filter(F.transform(closed, lambda p: without_leading_blanks(F.concat(p, F.lit(".")))), lambda s: F.length(s) >= shortest)


def words(text: Column) -> Column:
    """Runs of Unicode word characters."""
    return F.regexp_extract_all(text, F.lit(r"(?U)\w+"), F.lit(0))


def collapse_blanks(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\s+", " ")


def contains_any(text: Column, keywords: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for k in keywords:
        found = found | F.contains(text, F.lit(k))
    return found


def phrase_count(text: Column, pattern: str) -> Column:
    """Occurrences of a phrase in text whose white space is collapsed."""
    return F.regexp_count(collapse_blanks(text), F.lit(f"(?U){pattern}")).cast("long")


@F.pandas_udf(StringType())
def _composed(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def nfkc(text: Column) -> Column:
    """Compatibility composition, for which Spark has no built-in; only texts beyond ASCII, which it may change, leave the JVM."""
    return F.coalesce(_composed(F.when(~text.rlike(r"^[\x00-\x7F]*$"), text)), text)
