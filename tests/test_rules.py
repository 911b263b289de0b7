"""Rules on hand-written snippets: sentences, ids, seniority, labels, harvest, sources, sinks."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from draftmetrics.functions import dom
from draftmetrics.functions import html as h
from draftmetrics.functions import scalars as sc
from draftmetrics.functions import text as tx
from draftmetrics.functions import vectors as vec
from draftmetrics.functions.profiles import HANGUL
from draftmetrics.operators import engines
from draftmetrics.operators import features as ft
from draftmetrics.operators import labels as lb
from draftmetrics.operators import metrics as m
from draftmetrics.operators import profile as pr
from draftmetrics.sources import files, harvest, sinks


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column(F.col("v")).alias("x")).first().x


@pytest.mark.parametrize(
    "text,expected",
    [
        ("이 법은 공포한 날부터 시행한다.", ["이 법은 공포한 날부터 시행한다."]),
        ("2016. 01. 부터 시행하도록 한다. 남은 말", ["부터 시행하도록 한다."]),
        ("비율은 3.14 로 정하여야 한다.", ["비율은 3∙14 로 정하여야 한다."]),
        ("짧다.\r\n그러나 이 조항은 적용한다.\r끝이 없는 문장", ["그러나 이 조항은 적용한다."]),
        ("제1조 10. ) 목적은 이와 같다.", ["제1조 10∙ ) 목적은 이와 같다."]),
        ("This is not Hangul at all.", []),
        ("", []),
    ],
)
def test_sentences(spark, text, expected):
    assert one(spark, text, lambda c: tx.sentences(c, HANGUL.letters)) == expected


def test_loose_sentences_cross_lines(spark):
    assert one(spark, "다만 제2항의\n경우에는. 3.14 아님. x.", tx.loose_sentences) == ["다만 제2항의\n경우에는.", "14 아님."]


def test_mean_words_and_null_text(spark):
    docs = spark.createDataFrame([(1, "이 법은 시행한다 지금. 그 법은 오늘 폐지한다."), (2, None), (3, "없음")], "id long, text string")
    got = {r.id: (r.n_sentences, r.avg_words) for r in m.sentence_length(docs, "id", "text", HANGUL).collect()}
    assert got == {1: (2, 4.0), 2: (0, 0.0), 3: (0, 0.0)}


def test_exceptions_with_similarity(spark):
    docs = spark.createDataFrame([(1, "다만 이 경우는 제외한다. 그러나 아니다 한다. 예외로 한다고 한다. 보통의 문장이다. 다만 넷째 문장이다."), (2, "아무것도 없다.")], "id long, text string")
    found = m.exception_candidates(docs, "id", "text", HANGUL).withColumn("s", F.lit(0.5) + F.col("pos") * 0.1)
    rows = {r.id: r for r in m.exception_summary(docs, "id", found, F.col("s")).collect()}
    assert rows[1].exception_count == 4 and rows[1].examples.count(" | ") == 2 and rows[2].exception_count == 0
    none = m.exception_summary(docs, "id", found, F.lit(0.45)).collect()  # the threshold itself is not enough
    assert {r.exception_count for r in none} == {0}


def test_vague_terms(spark):
    docs = spark.createDataFrame([(1, "적절히 일정한 것을 필요 시에 필요시에 가끔 가끔 어느  정도 할 수도 있다 일정 수준"), (2, None)], "id long, text string")
    tag = F.when(F.col("token") == "일정한", "VA").otherwise("NNG")
    r = {x.id: x for x in m.vague_terms(docs, "id", "text", HANGUL, tag).collect()}
    assert (r[1]["적절히"], r[1]["일정하게"], r[1]["필요 시"], r[1]["가끔"], r[1]["어느 정도"], r[1]["할 수도"], r[1]["일정 수준"]) == (1, 1, 2, 2, 1, 1, 1)
    assert r[1].total == 9 and r[2].total == 0 and len(r[1]) == 32
    assert list(r[1].asDict())[1:5] == ["적절히", "충분히", "일부", "일정하게"] and list(r[1].asDict())[-2:] == ["자주", "total"]


def test_top_tokens_break_ties_by_first_appearance(spark):
    docs = spark.createDataFrame([(1, "b a c a b d"), (2, "x")], "id long, text string")
    vocabulary = spark.createDataFrame([("a",), ("b",), ("c",), ("",), (None,), ("a",)], "word string")
    counts = m.token_counts(docs, "id", "text", vocabulary)
    rows = {r.id: r for r in m.token_summary(docs, "id", counts).collect()}
    assert (rows[1].total, rows[1].uniq, rows[1].top) == (5, 3, "b:2, a:2, c:1") and rows[2].total == 0
    assert m.counts_json(counts, "id").first().counts_json == '{"a":2,"b":2,"c":1}'


def test_pick_senses(spark):
    rows = [(1, 0, 1.0, 0.1), (2, 0, 1.0, 0.4), (2, 1, 2.0, 0.44), (3, 0, 1.0, 0.6), (3, 1, 2.0, 0.7), (4, 0, 5.0, 0.9), (4, 1, 6.0, 0.9)]
    got = m.pick_senses(spark.createDataFrame(rows, "k long, sense_ord long, grade double, sim double"), ["k"])
    assert {r.k: r.grade for r in got.collect()} == {1: 1.0, 2: 1.0, 3: 2.0, 4: 5.0}


def test_ids_and_titles(spark):
    assert one(spark, "[2103147] 어떤 법률안(강선우의원 등 10인)", sc.bracket_id) == 2103147
    assert one(spark, "법률안(강선우의원 등 13 인)", sc.cosponsors) == 13
    assert one(spark, "법률안(정부)", sc.cosponsors) is None
    assert one(spark, "/a/b/[12] 제목.txt", sc.file_id) == "12"
    assert one(spark, "/a/b/x.y.txt", sc.file_id) == "x.y"
    assert one(spark, "3등급", sc.grade_number) == 3.0 and one(spark, "없음", sc.grade_number) is None


@pytest.mark.parametrize("text,base,expected", [("4선", 21, 4), ("3 선 제22대", 20, 2), ("초선(제21대)", 20, 1), ("재선 제21대 제22대", 20, 1), ("재선 제22대", 22, 2), ("의원", 21, None)])
def test_seniority(spark, text, base, expected):
    df = spark.createDataFrame([(text, base)], "t string, b int")
    terms = sc.ordinal_term(F.col("t"), HANGUL.ordinals)
    assert df.select(F.when(terms.isNotNull(), sc.seniority_at(terms, F.col("t"), F.col("b"))).alias("x")).first().x == expected


def test_binarize_and_tags(spark):
    assert [one(spark, v, lambda c: sc.binarize(c, 6), "int") for v in (3, 6, 7, None)] == [0, 0, 1, None]
    assert [one(spark, v, sc.tag_class) for v in ("NNG", "VV", "VA-I", "XSN", "NR", "MM")] == ["명사", "동사", "형용사", "접미사", "수사", "기타"]


def test_cosine(spark):
    assert one(spark, [1.0, 0.0], lambda c: vec.max_cosine(c, [[1.0, 1.0], [0.0, 1.0]]), "array<float>") == pytest.approx(2**-0.5)
    assert one(spark, [0.0, 0.0], lambda c: vec.cosine(c, c), "array<float>") is None


def test_html(spark):
    page = '<html><script>var t="</p>";</script><h3 class="detailh3">[12] <b>T</b></h3><a href="/x?billId=1">a</a><input value="/ 4 페이지"><a onclick="fnSearch(7)">7</a></html>'
    assert one(spark, page, lambda c: h.first_of(c, ("h3", "detailh3"), ("h1", "tit"))) == "[12] T"
    assert one(spark, page, lambda c: h.links(c, '[^"]*billId[^"]*')) == ["/x?billId=1"]
    assert one(spark, page, h.total_pages) == 4
    assert [one(spark, p, h.total_pages) for p in ("<a onclick='fnSearch(3)'>fnSearch(7)", "none")] == [7, 1]
    assert one(spark, page, h.page_text).startswith("[12] T")
    assert one(spark, "x({billNo: 'A1'})", lambda c: h.call_argument(c, "billNo")) == "A1"


def test_labelled_pairs_and_sections(spark):
    pages = spark.createDataFrame([(1, "<strong>제안일자</strong><div>2020-01-02</div><strong>제안일자</strong><div>2021-01-02</div><td class='m'><span>회의</span></td>"), (2, None)], "id long, html string")
    assert [(r.label, r.value) for r in h.labelled_pairs(pages, "id", "html", "strong", "div").collect()] == [("제안일자", "2021-01-02")]
    assert [(r.section, r.text) for r in h.sections(pages, "id", "html", ("span",)).collect()] == [("span", "회의")]


def test_labels(spark):
    good = '{"dimensions": [{"name": "a b", "score": 3, "rationale": "x"}, {"name": "a b", "score": 4, "rationale": "y"}, {"name": "odd", "score": 1, "rationale": ""}], "overall_score": 9, "notes": ""}'
    rows = spark.createDataFrame([(1, good), (2, "Sure:\n" + good + " done"), (3, "nothing"), (4, None)], "id long, raw string")
    parsed = lb.parse_answers(rows, "raw")
    ok, dead = sinks.split_failures(parsed)
    assert sorted(r.id for r in dead.collect()) == [3, 4] and "_error" not in ok.columns
    long = lb.flatten_answers(parsed, "id")
    assert sorted((r.id, r.dim, r.score) for r in long.collect()) == [(1, "a_b", 4.0), (1, "odd", 1.0), (2, "a_b", 4.0), (2, "odd", 1.0)]
    wide = lb.pivot_answers(long, "id", ["a_b"])
    assert {r.id: r.score_a_b for r in wide.collect()} == {1: 4.0, 2: 4.0} and wide.columns == ["id", "score_a_b", "rationale_a_b"]


def test_append_twice_is_append_once(spark):
    old, new = spark.createDataFrame([(1, "a")], "id long, x string"), spark.createDataFrame([(1, 5), (2, 6), (2, 6)], "id long, y long")
    once = lb.append_new(old, new, "id")
    twice = lb.append_new(once, new, "id")
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect()))[:] and once.columns == ["id", "x", "y"] and once.count() == 2


def test_natural_join_and_patches(spark):
    a = spark.createDataFrame([(1, 2, "x"), (None, 2, "y")], "k long, j long, a string")
    b = spark.createDataFrame([(1, 2, "p"), (1, 3, "q"), (None, 2, "r")], "k long, j long, b string")
    assert [r.b for r in ft.natural_join(a, b).collect()] == ["p"]
    assert sorted(r.b for r in ft.natural_join(a, b, null_safe=True).collect()) == ["p", "r"]
    assert [r.a for r in ft.without(a, b.select("k"), "k").collect()] == ["y"]
    fixed = ft.patched(spark.createDataFrame([(1, None), (2, 5)], "k long, v long"), spark.createDataFrame([(1, 168)], "k long, v long"), "k", "v")
    assert {r.k: r.v for r in fixed.collect()} == {1: 168, 2: 5}
    assert ft.coverage(a, b, "k").first() == (2, 1, 1)


def test_profile_of_constant_and_null_columns(spark):
    df = spark.createDataFrame([(1.0, 5.0, None), (2.0, 5.0, 1.0), (4.0, 5.0, None)], "a double, c double, n double")
    r = {(x.a, x.b): x.r for x in pr.corr_matrix(df, ["a", "c", "n"]).collect()}
    assert r["a", "a"] == pytest.approx(1) and r["a", "c"] is None and r["a", "n"] is None
    assert [(x.bin, x.n) for x in pr.histogram(df, "c", 2).orderBy("bin").collect()] == [(0, 3), (1, 0)]
    assert {x.column: x.n_null for x in pr.null_profile(df, ["a", "n"]).collect()} == {"a": 0, "n": 2}
    assert pr.histogram(df.limit(0), "a").count() == 0


def test_text_folder_with_other_encoding(spark, tmp_path):
    (tmp_path / "[1] a.txt").write_bytes("다만 그렇다.".encode("cp949"))
    (tmp_path / "b.txt").write_bytes("﻿utf8 텍스트".encode())
    (tmp_path / "c.pdf").write_bytes(b"%PDF")
    got = {r.doc: r.text for r in files.text_folder(spark, str(tmp_path)).collect()}
    assert got == {"1": "다만 그렇다.", "b": "utf8 텍스트"}
    assert [r.path.rsplit("/", 1)[1] for r in files.sorted_files(spark, str(tmp_path), "*.pdf").collect()] == ["c.pdf"]


def test_tables_and_id_lists(spark, tmp_path):
    (tmp_path / "ids.txt").write_text(" PRC_1 \n\n  \nPRC_2\n")
    assert [r.value for r in files.id_list(spark, str(tmp_path / "ids.txt")).collect()] == ["PRC_1", "PRC_2"]
    df = spark.createDataFrame([("가", ["x", "y"]), (None, None)], "word string, parties array<string>")
    sinks.write_csv(df, str(tmp_path / "out"), one_file=True)
    back = files.read_table(spark, str(tmp_path / "out"), "word string, parties string")
    assert sorted(map(tuple, back.collect()), key=str) == [("가", "x | y"), (None, None)]
    (tmp_path / "k.csv").write_bytes("word,grade\n다만,3등급\n".encode("cp949"))
    assert files.read_table_any(spark, str(tmp_path / "k.csv"), "word string, grade string").first().word == "다만"


def test_retries_and_pages(spark):
    tries = []

    def flaky(url):
        tries.append(url)
        if len(tries) < 3:
            raise OSError("busy")
        return "body"

    pauses = []
    assert harvest.with_retries(flaky, harvest.MEMBER_PAGES, pauses.append)("u") == ("body", None) and pauses == [0.25, 0.5]
    assert [harvest.JUDGE_CALLS.pause(n) for n in (1, 2, 3, 4)] == [1.0, 2.0, 4.0, 8.0]

    def fetch(url):
        if "bad" in url:
            raise ValueError("no")
        return f"<{url}>"

    urls = spark.createDataFrame([("a",), ("a",), ("bad",), (None,)], "url string")
    got = {r.url: (r.body, r._error) for r in harvest.fetch_pages(urls, "url", fetch, harvest.RetryPolicy(2, "fixed", 0.0)).collect()}
    assert got == {"a": ("<a>", None), "bad": (None, "ValueError: no")}


def test_cache_and_fanout(spark):
    now = dt.datetime(2024, 1, 2, 12)
    cache = spark.createDataFrame([("a", "x", dt.datetime(2024, 1, 2)), ("b", "y", dt.datetime(2024, 1, 1))], "url string, body string, fetched_at timestamp")
    urls = spark.createDataFrame([("a",), ("b",), ("c",)], "url string")
    missing, fresh = harvest.fetch_missing(urls, "url", cache, F.lit(now))
    assert sorted(r.url for r in missing.collect()) == ["b", "c"] and [r.url for r in fresh.collect()] == ["a"]
    pages = spark.createDataFrame([("u?x=1", "/ 2 페이지"), ("v", "")], "url string, html string")
    assert sorted(r.page_url for r in harvest.page_fanout(pages, "url", "html").collect()) == ["u?x=1&page=1", "u?x=1&page=2", "v?page=1"]


def test_append_stream_is_idempotent(spark, tmp_path):
    from draftmetrics.streaming.incremental import append_stream

    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "id long, x string").write.parquet(source)
    for _ in range(2):
        stream = spark.readStream.schema("id long, x string").parquet(source)
        append_stream(stream, "id", target, str(tmp_path / "cp")).awaitTermination()
        spark.createDataFrame([(2, "z"), (3, "c")], "id long, x string").write.mode("append").parquet(source)
    assert sorted(r.id for r in spark.read.parquet(target).collect()) == [1, 2, 3]


@pytest.mark.parametrize("digits", [2, 3])
def test_rounding_is_that_of_the_binary_value(spark, digits):
    import random

    rng = random.Random(1)
    values = [2.675, 0.125, 0.375, 1.005, 2.5, -2.675, -0.125, 0.0, 1e9 + 0.005, 3.14159, 1 / 3] + [rng.uniform(-100, 100) for _ in range(3000)] + [k / 8 for k in range(-40, 40)] + [round(rng.uniform(0, 9), digits + 1) for _ in range(3000)]
    got = spark.createDataFrame([(v,) for v in values], "v double").select("v", sc.rounded(F.col("v"), digits).alias("r")).collect()
    assert all(x.r == round(x.v, digits) for x in got)


def test_strict_dates(spark):
    assert one(spark, "2020-06-01", sc.strict_date) == dt.date(2020, 6, 1) and one(spark, None, sc.strict_date) is None
    for bad in ("2020-6-1", "2020-02-30", "01.06.2020", "", "2020-06-01 "):
        with pytest.raises(Exception):
            one(spark, bad, sc.strict_date)
        assert one(spark, bad, sc.lenient_date) is None


def test_senses_count_each_occurrence_once(spark):
    docs = spark.createDataFrame([(1, "법률을 정하고 법률을 지킨다."), (2, "없음"), (3, None)], "id long, text string")
    lexicon = spark.createDataFrame([("법률을", "명사", 0, 1.0, 3), ("법률을", "명사", 1, 5.0, 9), ("법률을", "동사", 0, 3.0, 9), ("정하고", "명사", 0, 2.0, 0)], "word string, pos string, sense_ord int, grade double, gloss int")
    tokens = lambda s: F.transform(tx.words(s), lambda w: F.struct(w.alias("form"), F.lit("NNG").alias("tag")))

    def grades(**options):
        return {r.id: (r.n_sentences, r.n_matched, r.avg_grade) for r in m.vocabulary_grade(docs, "id", "text", lexicon, HANGUL, tokens, **options).collect()}

    assert grades() == {1: (1, 3, pytest.approx(4 / 3)), 2: (0, 0, None), 3: (0, 0, None)}
    assert grades(similarity=lambda s, gloss: gloss / 10)[1] == (1, 3, 4.0)  # the second sense is nearer
    assert grades(similarity=lambda s, gloss: gloss / 100)[1][2] == pytest.approx(4 / 3)  # neither is near enough
    assert grades(similarity=lambda s, gloss: F.lit(0.8))[1][2] == pytest.approx(4 / 3)  # a tie goes to the first
    assert grades(digits=3)[1][2] == 1.333
    several = m.vocabulary_grade(docs, "id", "text", lexicon.drop("pos", "gloss"), HANGUL)
    assert several.filter("id = 1").first().n_matched == 3


PAGE = """<div class="section"><h4>법사위 회의정보</h4><table><tbody><tr><td class="mtngName x"><span> 제1차
 회의 </span><i><span>no</span></i></td></tr></tbody></table></div>
<table><caption>소관위 회의정보 표</caption><tbody><tr><td class="mtngName"><span>소위</span><span> </span></td></tr></table>
<ul class="member_list_img"><li><a href="https://x/assembly.go.kr/members/1"><p class="jdang">가당</p></a></li><li><p class="jdang b">나당</p></ul>
<input id="pager_pages_text" value=" (1/2 페이지)"><div class="paging-navigation"><a class="number" onclick="fnSearch(9)">9</a></div><a onclick="fnSearch(70)">x</a> / 55 페이지"""


def test_tables_by_heading_and_caption():
    assert dom.meeting_names(PAGE) == [("소관위 회의정보", "소위"), ("법사위 회의정보", "제1차 회의")]
    assert dom.meeting_names(None) == [] and dom.meeting_names("<h4>본회의 심의정보</h4><table></table>") == []
    root = dom.parse(PAGE)
    assert [n.text() for n in root.select("ul.member_list_img p.jdang")] == ["가당", "나당"]
    assert [n.attributes["href"][-1] for n in root.select("ul.member_list_img a[href*='assembly.go.kr/members']")] == ["1"]
    assert len(root.select("td.mtngName > span")) == 3 and len(root.select("td.mtngName span")) == 4


def test_pages_are_counted_in_the_pager_alone():
    assert dom.page_count(PAGE) == 2
    assert dom.page_count(PAGE.replace("(1/2 페이지)", "")) == 9
    assert dom.page_count("fnSearch(3) / 4 페이지") == 1 and dom.page_count(None) == 1


def test_profiles():
    old = "<dl><dt>정당</dt><dd>가</dd><dt>당선횟수</dt><dd>3선 <b>(제20대)</b></dd></dl>"
    new = "<div class='jeonzik_left_info'><div class='profile_info'><dl><dt>초선</dt><dd>(제21대)</dd></dl></div></div>"
    assert dom.profile_text(old) == "3선 (제20대)" and dom.profile_text(new) == "초선 (제21대)"
    assert dom.profile_text("<dt>당선횟수</dt><dd> </dd>" + new) == "초선 (제21대)"
    assert dom.profile_text("<dt>당선횟수 </dt><dd>2선</dd>") is None and dom.profile_text(None) is None


def test_pages_as_tables(spark):
    pages = spark.createDataFrame([(1, PAGE), (2, None)], "id long, html string")
    assert sorted((r.section[:2], r.name) for r in dom.meetings(pages, "id", "html").collect()) == [("법사", "제1차 회의"), ("소관", "소위")]
    assert [r.value for r in dom.selected(pages, "id", "html", "p.jdang").orderBy("value").collect()] == ["가당", "나당"]
    assert one(spark, '<h3 class="a detailh3" title="[7] T">x</h3>', lambda c: h.titled_element(c, "h3", "detailh3")) == "[7] T"
    assert one(spark, '<h3 class="detailh3">[8]</h3>', lambda c: h.titled_element(c, "h3", "detailh3")) == "[8]"
    assert one(spark, '<p class="x tit y">t</p>', lambda c: h.element(c, "p", "tit")) == "t"


def test_references_without_semicolon_stay(spark):
    html = "<h1>a&amp;b &lt;c&gt; &amp</h1><h1 title='x&copy=1&amp;y'>&unknown; & &#65; &ampx; ver&ltz</h1>"
    pages = spark.createDataFrame([(1, html)], "id long, html string")
    assert sorted(r.value for r in dom.selected(pages, "id", "html", "h1").collect()) == sorted(["a&b <c> &amp", "&unknown; & A &ampx; ver&ltz"])
    assert dom.parse(html).select("h1")[1].attributes["title"] == "x&copy=1&y"


def test_tables_decide_on_their_encoding_one_by_one(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes('word,grade\n다만,3\n"두\n줄",\n'.encode("cp949"))
    (tmp_path / "b.csv").write_bytes("﻿grade,word\n4,그러나\n\n5,가\n".encode())
    got = files.read_table_any(spark, str(tmp_path), "word string, grade int").collect()
    assert sorted(map(tuple, got), key=str) == sorted([("다만", 3), ("두\n줄", None), ("그러나", 4), ("가", 5)], key=str)
    (tmp_path / "c.csv").write_bytes(b"other\n1\n")
    with pytest.raises(Exception):
        files.read_table_any(spark, str(tmp_path), "word string, grade int").collect()


def test_a_failed_write_leaves_the_old_table(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.write_parquet(spark.range(3), path)
    with pytest.raises(Exception):
        sinks.write_parquet(spark.range(5).select((F.raise_error(F.lit("no")).cast("long")).alias("id")), path)
    assert spark.read.parquet(path).count() == 3
    sinks.write_parquet(spark.read.parquet(path).filter("id > 0"), path)  # from the table itself
    assert spark.read.parquet(path).count() == 2 and [p.name for p in tmp_path.iterdir()] == ["t"]
    sinks.write_scores(spark.createDataFrame([("m", 1, 0.5)], "model string, perm_id long, score double"), path, metric="f1_macro", n_permutations=1)
    assert spark.read.parquet(path).first().metric == "f1_macro"
    log = str(tmp_path / "log")
    for _ in range(2):
        sinks.append_failures(spark.createDataFrame([("x", "Traceback")], "path string, _error string"), log)
    assert spark.read.parquet(log).filter("failed_at IS NOT NULL").count() == 2
    line = sinks.report_lines(spark.createDataFrame([("svc", 0.5, 1, 2, 3, 4)], "model string, accuracy double, tn long, fp long, fn long, tp long")).first().line
    assert line == "=== svc ===, accuracy 0.500, tn 1, fp 2, fn 3, tp 4"


def test_info(spark):
    got = pr.info(spark.createDataFrame([(1, None), (2, "x")], "a long, b string")).orderBy("position").collect()
    assert [tuple(r) for r in got] == [(0, "a", "bigint", 2, 2), (1, "b", "string", 2, 1)]


def test_quantiles_are_exact(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    for values in (rng.normal(size=101), rng.integers(0, 5, 50).astype(float), np.array([3.0])):
        df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "a double")
        q = pr.quantiles(df.repartition(5), ["a"], [0.25, 0.5, 0.75]).first().q
        assert np.allclose(q, np.quantile(values, [0.25, 0.5, 0.75]))
    assert pr.describe(spark.createDataFrame([(None,)], "a double"), ["a"]).first().q50 is None


def test_sessions_listings_and_caches(spark, tmp_path):
    class Board:
        """A session that must see the page before the form."""

        def __init__(self):
            self.seen = None

        def get(self, url):
            self.seen = url
            if "bad" in url:
                raise OSError("gone")
            return "page"

        def post(self, url, form, headers):
            return f"{url}|{form['billId']}|{headers['Referer'] == self.seen}"

    none = harvest.RetryPolicy(2, "fixed", 0.0)
    ids = spark.createDataFrame([("A 1",), ("bad",)], "id string")
    got = {r.id: r for r in harvest.fetch_forms(ids, "id", Board, "http://p", "http://f", "billId", policy=none).collect()}
    assert got["A 1"].body == "http://f|A 1|True" and got["bad"].body is None and got["bad"]._error == "OSError: gone"

    def listing(url):
        if "pageNo=" not in url:
            return "nothing"
        return "<li>member " + url[-1] + '</li><input id="pager_pages_text" value="1/3 페이지">'

    pages = harvest.fetch_listings(spark.createDataFrame([("u?x=1",)], "url string"), "url", listing, lambda body: "member" in body, none)
    assert [(r.page, "member " + str(r.page) in r.body) for r in pages.orderBy("page").collect()] == [(1, True), (2, True), (3, True)]
    with pytest.raises(OSError):
        harvest.with_retries(Board().get, none, lambda s: None, raising=True)("bad")
    waits = []
    harvest.rest((0.5, 1.2), waits.append)
    harvest.rest(0.0, waits.append)
    assert len(waits) == 1 and 0.5 <= waits[0] <= 1.2

    def fetch(url):
        if url == "bad":
            raise OSError("x")
        return "new " + url

    cache, urls = str(tmp_path / "cache"), spark.createDataFrame([("a",), ("bad",)], "url string")
    run = lambda when, **o: {r.url: r.body for r in harvest.fetch_cached(urls, "url", fetch, cache, F.lit(when), policy=none, **o).collect()}
    day = dt.datetime(2024, 1, 1)
    assert run(day) == {"a": "new a", "bad": None}
    sinks.write_parquet(spark.read.parquet(cache).withColumn("body", F.lit("kept")), cache)
    assert run(day + dt.timedelta(hours=23))["a"] == "kept" and run(day + dt.timedelta(hours=23), use_cache=False)["a"] == "new a"
    assert run(day + dt.timedelta(hours=25))["a"] == "new a" and spark.read.parquet(cache).count() == 1


def test_engines(spark):
    class Bits:
        def encode(self, texts):
            return [[float(len(t)), 1.0] for t in texts]

    class Oracle(engines.ReplayJudge):
        """Fails once for each document, keeps count of what it stores."""

        def __init__(self):
            engines.ReplayJudge.__init__(self, {"a": '{"dimensions": []}', "b": "no json"})
            self.held, self.failed = [], set()

        def upload(self, name, content):
            self.held.append(name)
            return name

        def ask(self, handle, prompt):
            if handle not in self.failed:
                self.failed.add(handle)
                raise OSError("busy")
            return engines.ReplayJudge.ask(self, handle, prompt) + str(len(self.held))

        def delete(self, handle):
            self.held.remove(handle)

    df = spark.createDataFrame([(1, "두 말", "a", b"x"), (2, None, "b", None)], "id long, text string, name string, content binary")
    got = df.select("id", engines.tagged_tokens(F.col("text")).alias("k"), engines.embedded(F.col("text"), Bits).alias("e")).orderBy("id").collect()
    assert [(t.form, t.tag) for t in got[0].k] == [("두", "NNG"), ("말", "NNG")] and got[0].e == [3.0, 1.0] and got[1].k is None and got[1].e is None
    policy = harvest.RetryPolicy(3, "doubling", 0.0)
    rows = {r.id: r for r in engines.judged(df.coalesce(1), "id", "name", "content", "?", Oracle, lambda raw: "{" in raw, policy).collect()}
    assert rows["1"].raw == '{"dimensions": []}1' and rows["2"].raw is None and "no answer in" in rows["2"]._error and "Traceback" in rows["2"]._error


def test_unknown_dimensions(spark):
    long = spark.createDataFrame([(1, "a", 1.0, ""), (1, "misspelt", 2.0, "")], "id long, dim string, score double, rationale string")
    assert [r.dim for r in lb.unknown_dimensions(long, ["a"]).collect()] == ["misspelt"]


@pytest.mark.parametrize("text,expected", [(" \u3000\nA b c d. ..x\r\n e f g h.\u2003", ["A b c d.", "x\r\n e f g h."]), (". .", []), ("", []), (None, None)])
def test_loose_sentences_of_odd_texts(spark, text, expected):
    assert one(spark, text, tx.loose_sentences) == expected


def test_a_long_text_without_a_full_stop_is_read_once(spark):
    """What follows the last full stop is not searched from each of its characters."""
    started = dt.datetime.now()
    assert one(spark, "Abc def. " + "lorem " * 100_000, tx.loose_sentences) == ["Abc def."]
    assert (dt.datetime.now() - started).total_seconds() < 20


@pytest.mark.parametrize("blank", list(" \t\n\r\x0b\x0c\x85\u2028\u3000"))
def test_blanks_of_any_kind_are_trimmed(spark, blank):
    assert one(spark, f"{blank} a{blank}b {blank}", tx.trim_blanks) == f"a{blank}b"
