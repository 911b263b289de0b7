"""Senses by glosses in batches, against the choice by columns and plain sets."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from draftmetrics.functions.profiles import LATIN
from draftmetrics.operators import encoder, glosses
from draftmetrics.operators import metrics as m

TEXTS = ["", "a", "é", "ab", "the the the", "日本語 x", "𝒳𝒴 z", "a longer line, with İ and more of it " * 40]


def test_numbers_of_a_batch_are_those_of_plain_sets():
    got = encoder.numbers_of(pa.array([" ".join(x.split()).lower() for x in TEXTS] + [None])).to_pylist()
    assert [set(x) for x in got[:-1]] == [encoder.plain_buckets(x) for x in TEXTS] and all(len(set(x)) == len(x) for x in got[:-1]) and got[-1] is None
    assert encoder.numbers_of(pa.array([], pa.string())).to_pylist() == []


@pytest.fixture(scope="module")
def given(spark):
    rng = np.random.default_rng(2)
    words = ["bank", "river", "money", "spring", "water", "coil", "season", "of", "the"]
    texts = [". ".join(" ".join(rng.choice(words, rng.integers(1, 9))) for _ in range(rng.integers(1, 6))) + "." for _ in range(60)] + ["", None, "no full stop", "Bank bank bank bank. bank!", "The " * 3000 + "bank."]
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "id long, text string")
    items = ["bank of the river water", "bank of money", "spring water of the river", "spring season", "spring coil", "", "bank of money"]
    texts = spark.createDataFrame(list(enumerate(items)), "gloss_id int, s string").select("gloss_id", encoder.buckets(F.col("s")).cast("array<int>").alias("numbers"))
    senses = [("bank", 0, 1.0, 0), ("bank", 1, 2.0, 1), ("bank", 2, 7.0, 6), ("spring", 3, 3.0, 2), ("spring", 4, None, 3), ("spring", 9, 5.0, 4), ("water", 0, 2.5, 5), ("coil", 1, None, 4), ("season", 0, 1.5, 5), ("season", 1, 2.5, 3)]
    return docs, spark.createDataFrame(senses, "word string, sense_ord int, grade double, gloss_id int"), texts


def rows_of(df):
    return {r.id: (r.n_sentences, r.n_matched, None if r.avg_grade is None else round(r.avg_grade, 9)) for r in df.collect()}


@pytest.mark.parametrize("threshold", [0.0, 0.2, 0.45, 2.0])
def test_grades_are_those_of_columns(given, threshold, monkeypatch):
    docs, senses, texts = given
    lexicon = senses.join(texts, "gloss_id").select("word", "sense_ord", "grade", F.col("numbers").cast("array<bigint>").alias("gloss"))
    want = rows_of(m.vocabulary_grade(docs, "id", "text", lexicon, LATIN, similarity=encoder.overlap, threshold=threshold, view=encoder.buckets))
    monkeypatch.setattr(glosses, "LOOKUPS", 50)
    assert rows_of(glosses.gloss_grade(docs, "id", "text", senses, texts, LATIN, threshold)) == want and len(want) == 65
    if threshold == 0.2:
        monkeypatch.setattr(glosses, "GLOSSES", 0)
        assert rows_of(glosses.gloss_grade(docs, "id", "text", senses, texts, LATIN, threshold)) == want
        assert set(rows_of(glosses.gloss_grade(docs, "id", "text", senses.limit(0), texts.limit(0), LATIN)).values()) >= {(0, 0, None)}


def test_a_gloss_is_compared_with_a_sentence_once(given, monkeypatch):
    """However often the words of a very long sentence occur, its numbers meet each gloss once."""
    _, senses, texts = given
    held, asked, plain = glosses.Senses(senses.collect(), texts.collect()), [], glosses.Senses.overlaps
    monkeypatch.setattr(glosses.Senses, "overlaps", lambda self, s, g, *a: asked.append(len(s)) or plain(self, s, g, *a))
    n, total = held.grades(pa.array(["bank " * 5000 + "spring"]), pa.array([["bank"] * 5000 + ["spring"]]), 0.2)
    assert n[0] in (5000, 5001) and sum(asked) == 6
