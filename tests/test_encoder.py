"""The n-gram encoder against plain sets, and what is built on it."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from draftmetrics.functions import scalars as sc
from draftmetrics.functions.profiles import HANGUL
from draftmetrics.operators import encoder, engines
from draftmetrics.operators import metrics as m

TEXTS = ["다만 제2항의 경우에는 이를 적용하지 아니한다.", "Ab  c\nd", "a", "é", "", "   ", None, "aaaa", "ab cd", "이 법은 공포한 날부터 시행한다."]


def test_numbers_equal_plain_ones(spark):
    got = spark.createDataFrame([(t,) for t in TEXTS], "t string").select("t", encoder.buckets(F.col("t")).alias("b")).collect()
    for r in got:
        assert r.b is None if r.t is None else (set(r.b) == encoder.plain_buckets(r.t) and len(r.b) == len(set(r.b)))


def test_similarity_against_plain_cosines(spark):
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(TEXTS)], "id long, t string")
    sets = {k: encoder.plain_buckets(t) for k, t in enumerate(TEXTS) if t is not None}
    df = Counter(x for s in sets.values() for x in s)
    w = {x: math.log((len(sets) + 1) / (n + 1)) for x, n in df.items()}
    rare = math.log(len(sets) + 1)

    def cos(a, b):
        size = lambda s: math.sqrt(sum(w.get(x, rare) ** 2 for x in s))
        return sum(w.get(x, rare) ** 2 for x in a & b) / size(a) / size(b) if size(a) and size(b) else 0.0

    exemplars = ["ab cd ef", HANGUL.exemplars[3]]
    got = encoder.with_similarity(rows, "t", exemplars, encoder.fit(rows, "t")).collect()
    for r in got:
        want = None if r.t is None else max(cos(sets[r.id], encoder.plain_buckets(e)) for e in exemplars)
        assert r.similarity == (want if want is None else pytest.approx(want, abs=1e-12))
    assert {r.id for r in got if r.similarity == pytest.approx(1.0)} == {0}


def test_exceptions_by_the_profile_s_exemplars(spark):
    other = "그러나 그 밖의 사항은 국회규칙으로 정하고 시행에 필요한 것은 위원회가 의결한다."
    text = "이 법은 공포한 날부터 시행한다. 다만 제3항의 경우에는 이를 적용하지 아니한다. " + other
    docs = spark.createDataFrame([(1, text), (2, "예외가 없다."), (3, None)], "id long, text string")
    got = {r.id: r for r in m.exception_similarity(docs, "id", "text", HANGUL).collect()}
    assert got[1].exception_count == 1 and got[1].avg_similarity > 0.45 and got[1].examples == "다만 제3항의 경우에는 이를 적용하지 아니한다."
    assert (got[2].exception_count, got[2].avg_similarity, got[3].exception_count) == (0, 0.0, 0)


def test_dense_vectors_have_length_one(spark):
    got = spark.createDataFrame([("ab cd",), (None,), ("",)], "t string").select(engines.embedded(F.col("t")).alias("e")).collect()
    assert math.isclose(sum(x * x for x in got[0].e), 1.0) and got[1].e is None and not any(got[2].e)


def test_engines_are_told_apart_by_what_they_hold():
    make = lambda word: lambda: word
    assert [engines.engine(make(w)) for w in ("first", "second", "first")] == ["first", "second", "first"]


@pytest.mark.parametrize("x,digits", [(1234567890123.456, 2), (-1234567890123.456, 2), (4503599627370495.5, 0), (4503599627370496.0, 2), (9.5e15, 1), (70000000000000.016, 2), (1e300, 3)])
def test_large_values_are_rounded(spark, x, digits):
    assert spark.createDataFrame([(x,)], "x double").select(sc.rounded(F.col("x"), digits)).first()[0] == round(x, digits)


def test_deeply_nested_pages():
    from draftmetrics.functions import dom, html

    page = "<div>" + "<p>x " * 3000 + "</div><h1>end</h1>"
    root = dom.parse(page)
    assert len(root.select("p")) == 3000 and root.text().endswith("x end") and [n.text() for n in root.select("h1")] == ["end"]
    assert html.parse_elements(page)[-1] == ("h1", "", "end")
    assert dom.parse("<p>a<script>b</script><style>c</style>d</p>").text() == "a d"


def test_compatibility_characters_are_composed(spark):
    import unicodedata

    from draftmetrics.functions import text as tx

    texts = ["ﬁ ① Ａ ㎏", "e\u0301 é", "ｶﾞ", "plain\nASCII", "", None, "한글", "\u1112\u1161\u11ab", "①" * 3 + "\n"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(tx.nfkc(F.col("t"))).collect()
    assert [r[0] for r in got] == [None if t is None else unicodedata.normalize("NFKC", t) for t in texts] and got[0][0] == "fi 1 A kg"


def test_extractions_that_found_nothing(spark):
    from draftmetrics.sources import sinks

    df = spark.createDataFrame([(1, ["a"]), (2, []), (3, None)], "id long, found array<string>")
    assert sorted(r.id for r in sinks.empty_extractions(df, "found").collect()) == [2, 3]
