"""Scalar functions on ids, dates, scores and rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def extract(c: Column, pattern: str, group: int = 1) -> Column:
    """The first match's group; null where nothing matches."""
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def extract_number(c: Column, pattern: str) -> Column:
    return extract(c, pattern).try_cast("bigint")


def bracket_id(c: Column, anchored: bool = False) -> Column:
    """The number in the first (or leading) square brackets."""
    return extract_number(c, r"^\[(\d+)\]" if anchored else r"\[(\d+)\]")


def file_id(path: Column) -> Column:
    """``[n]`` at the start of a file's name, else the name without its suffix."""
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    stem = F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")
    return F.coalesce(extract(name, r"^\[(\d+)\]"), stem)


def cosponsors(title: Column) -> Column:
    """"… 등 13 인": the number of proposers in a title."""
    return extract_number(title, r"등\s*([0-9]+)\s*인")


def ordinal_term(text: Column, ordinals: tuple[tuple[str, int], ...], numeric: str = r"(\d+)\s*선") -> Column:
    """Terms of office: a number before the unit, else the first ordinal word of the list that occurs."""
    by_word = F.lit(None).cast("int")
    for word, n in reversed(ordinals):
        by_word = F.when(F.contains(text, F.lit(word)), n).otherwise(by_word)
    return F.coalesce(extract(text, numeric).try_cast("int"), by_word)


def seniority_at(terms: Column, text: Column, base: Column, markers: tuple[tuple[str, int], ...] = (("제21대", 21), ("제22대", 22))) -> Column:
    """Terms without those after the base assembly, at least one."""
    out = terms
    for marker, assembly in markers:
        out = out - F.when(F.contains(text, F.lit(marker)) & (base < assembly), 1).otherwise(0)
    return F.greatest(F.lit(1), out)


def days_between(start: Column, end: Column) -> Column:
    return F.datediff(end, start).cast("long")


def binarize(score: Column, cut: int) -> Column:
    """0 up to the cut, 1 beyond; null stays null."""
    return F.when(score.isNull(), None).when(score <= cut, 0).otherwise(1)


def tag_class(tag: Column) -> Column:
    """Part-of-speech tags as classes of the lexicon."""
    return (
        F.when(tag.startswith("NN"), "명사").when(tag.startswith("VV"), "동사").when(tag.startswith("VA"), "형용사")
        .when(tag.startswith("XSN"), "접미사").when(tag == "NR", "수사").otherwise("기타")
    )


def grade_number(c: Column) -> Column:
    """"3등급" as 3.0; null where there is no number."""
    return extract(c, r"(\d+)").try_cast("double")


def strict_date(c: Column, pattern: str = "yyyy-MM-dd") -> Column:
    """A date in exactly this form; null stays null, anything else is an error."""
    whole = F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), c) if pattern == "yyyy-MM-dd" else c
    return F.when(c.isNull(), F.lit(None).cast("date")).when(whole.isNull(), F.raise_error(F.concat(F.lit("no date: "), c)).cast("date")).otherwise(F.to_date(whole, pattern))


def lenient_date(c: Column) -> Column:
    """The same, with null for what is no date."""
    return F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(c, "yyyy-MM-dd"))


def rounded(c: Column, digits: int) -> Column:
    """Rounded by the value that the binary number has exactly, ties to even (2.675 to 2.67, 0.125 to 0.12).

    The product with the power of ten is taken as a sum of two doubles without error.
    """
    x, scale = c.cast("double"), float(10**digits)
    # from 2^53 / 10^digits on doubles lie further apart than a place, so each is its own rounding
    exact = F.abs(x) < float(2**53) / scale
    big = x * F.lit(134217729.0)
    high = big - (big - x)
    low = x - high
    total = high * scale + low * scale
    rest = (high * scale - total) + low * scale
    n = F.floor(total).cast("double")
    over = (total - n - 0.5) + rest
    up = (over > 0) | ((over == 0) & (F.pmod(n, F.lit(2.0)) == 1))
    return F.when(exact, (n + F.when(up, 1.0).otherwise(0.0)) / scale).otherwise(x)


def truncated(c: Column) -> Column:
    return c.cast("double").cast("long")
