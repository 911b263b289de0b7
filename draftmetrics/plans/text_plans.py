"""Text metrics over ``documents``, ``benchmark``, ``conversations`` and ``embeddings``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from draftmetrics.functions import scalars as sc
from draftmetrics.functions import text as tx
from draftmetrics.functions import vectors as vec
from draftmetrics.functions.profiles import EXACT, LATIN, PHRASE, START
from draftmetrics.operators import encoder
from draftmetrics.operators import glosses as gl
from draftmetrics.operators import metrics as m
from draftmetrics.operators import morphology as mo
from draftmetrics.session import ship_package
from draftmetrics.sources import sinks
from draftmetrics.sources.files import clean_lexicon

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


WORD = r"[\p{L}\p{M}\p{N}_]+"
KEYWORDS = " OR ".join(f"contains(s, '{k}')" for k in LATIN.exception_keywords)

SENTENCES = r"""
lines AS (SELECT doc_id, i, regexp_replace(line, '^\s+|\s+$', '', 'g') AS line FROM (SELECT doc_id, unnest(string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10))) AS line, generate_subscripts(string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10)), 1) AS i FROM documents)),
safe AS (SELECT doc_id, i, regexp_replace(regexp_replace(regexp_replace(line, '(\d)\.(\s*\d)', '\1∙\2', 'g'), '(\d)\.(\s*\d)', '\1∙\2', 'g'), '(\d)\.(\s*$|\s+[)\]])', '\1∙\2', 'g') AS line FROM lines WHERE line <> ''),
cut AS (SELECT doc_id, unnest(list_slice(string_split(line, '.'), 1, -2)) AS p FROM safe),
sent AS (SELECT doc_id, s FROM (SELECT doc_id, regexp_replace(p || '.', '^\s+', '') AS s FROM cut) WHERE length(s) >= 7 AND regexp_matches(s, '\p{L}\.$'))
"""

LENGTHS = rf"""
WITH {SENTENCES},
per AS (SELECT doc_id, count(*) AS n_sentences, CAST(sum(len(regexp_extract_all(s, '{WORD}'))) AS BIGINT) AS n_words FROM sent GROUP BY doc_id),
lengths AS (SELECT d.doc_id, coalesce(n_sentences, 0) AS n_sentences, coalesce(n_words, 0) AS n_words, coalesce(n_words / n_sentences, 0.0) AS avg_words FROM documents d LEFT JOIN per USING (doc_id))
"""


@query(LENGTHS + "SELECT doc_id, n_sentences, n_words, round(avg_words, 6) AS avg_words FROM lengths")
def sentence_length_metric(spark: SparkSession, d: str) -> DataFrame:
    return m.sentence_length(t(spark, d, "documents"), "doc_id", "text", LATIN).withColumn("avg_words", F.round("avg_words", 6))


@query(LENGTHS + "SELECT CAST(quality AS BIGINT) AS quality, count(*) AS n_docs, CAST(sum(n_sentences) AS BIGINT) AS n_sentences, round(avg(avg_words), 6) AS mean_avg_words FROM lengths JOIN labels USING (doc_id) GROUP BY quality")
def quality_by_sentence_length(spark: SparkSession, d: str) -> DataFrame:
    # labels first: only labelled documents are cut into sentences
    labelled = t(spark, d, "documents").select("doc_id", "text").join(t(spark, d, "labels").select("doc_id"), "doc_id", "left_semi")
    joined = m.sentence_length(labelled, "doc_id", "text", LATIN).join(t(spark, d, "labels").select("doc_id", "quality"), "doc_id")
    return joined.groupBy(F.col("quality").cast("long").alias("quality")).agg(F.count("*").alias("n_docs"), F.sum("n_sentences").alias("n_sentences"), F.round(F.avg("avg_words"), 6).alias("mean_avg_words"))


@query(
    rf"""
WITH s AS (SELECT doc_id, regexp_replace(unnest(x), '^\s+|\s+$', '', 'g') AS s, generate_subscripts(x, 1) AS pos FROM (SELECT doc_id, regexp_extract_all(text, '[^.]+?\.') AS x FROM documents)),
k AS (SELECT doc_id, s, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS rn FROM s WHERE length(s) >= 6 AND ends_with(s, '.') AND ({KEYWORDS})),
g AS (SELECT doc_id, count(*) AS n, string_agg(CASE WHEN rn <= 3 THEN s END, ' | ' ORDER BY rn) AS e FROM k GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0) AS exception_count, CAST(0.0 AS DOUBLE) AS avg_similarity, coalesce(e, '') AS examples FROM documents d LEFT JOIN g USING (doc_id)
"""
)
def exception_sentences(spark: SparkSession, d: str) -> DataFrame:
    docs = t(spark, d, "documents")
    return m.exception_summary(docs, "doc_id", m.exception_candidates(docs, "doc_id", "text", LATIN))


_CANDIDATES_SQL = rf"""
WITH s AS (SELECT doc_id, regexp_replace(unnest(x), '^\s+|\s+$', '', 'g') AS s, generate_subscripts(x, 1) AS pos FROM (SELECT doc_id, regexp_extract_all(text, '[^.]+?\.') AS x FROM documents)),
k AS (SELECT doc_id, s, pos FROM s WHERE length(s) >= 6 AND ends_with(s, '.') AND ({KEYWORDS}))"""
_POINTS = "list_transform(string_split(trim(lower(regexp_replace({}, '\\s+', ' ', 'g'))), ''), lambda c: CAST(unicode(c) AS BIGINT))"
_P, _D = encoder.BASE, encoder.DIMENSIONS
#: The distinct numbers of n-grams of 2 and 3 code points ``cp``.
_BUCKETS = f"list_distinct(list_concat(list_transform(range(1, len(cp)), lambda i: ((2 * {_P} + cp[i]) % {_D} * {_P} + cp[i + 1]) % {_D}), list_transform(range(1, len(cp) - 1), lambda i: (((3 * {_P} + cp[i]) % {_D} * {_P} + cp[i + 1]) % {_D} * {_P} + cp[i + 2]) % {_D})))"


@query(
    _CANDIDATES_SQL
    + f""",
b AS (SELECT doc_id, pos, s, {_BUCKETS} AS b FROM (SELECT *, {_POINTS.format("s")} AS cp FROM k)),
e AS (SELECT row_number() OVER (ORDER BY doc_id, pos) AS e, b FROM b QUALIFY e <= 4),
w AS (SELECT k, pow(ln(((SELECT count(*) FROM b) + 1) / (count(*) + 1)), 2) AS w FROM (SELECT unnest(b) AS k FROM b) GROUP BY k),
m AS (SELECT doc_id, pos, sum(w) AS m FROM (SELECT doc_id, pos, unnest(b) AS k FROM b) JOIN w USING (k) GROUP BY doc_id, pos),
em AS (SELECT e, sum(w) AS m FROM (SELECT e, unnest(b) AS k FROM e) JOIN w USING (k) GROUP BY e),
dots AS (SELECT doc_id, pos, e, sum(w) AS d FROM (SELECT doc_id, pos, unnest(b) AS k FROM b) JOIN (SELECT e, unnest(b) AS k FROM e) USING (k) JOIN w USING (k) GROUP BY doc_id, pos, e),
sims AS (SELECT doc_id, pos, max(CASE WHEN m.m * em.m > 0 THEN d / sqrt(m.m) / sqrt(em.m) ELSE 0 END) AS sim FROM dots JOIN m USING (doc_id, pos) JOIN em USING (e) GROUP BY doc_id, pos),
h AS (SELECT doc_id, s, round(sim, 3) AS sim, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS rn FROM sims JOIN k USING (doc_id, pos) WHERE sim > 0.45),
g AS (SELECT doc_id, count(*) AS n, round(avg(sim), 3) AS a, string_agg(CASE WHEN rn <= 3 THEN s END, ' | ' ORDER BY rn) AS e FROM h GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0) AS exception_count, coalesce(a, 0.0) AS avg_similarity, coalesce(e, '') AS examples FROM documents d LEFT JOIN g USING (doc_id)
"""
)
def exception_similarity(spark: SparkSession, d: str) -> DataFrame:
    """The encoder's similarity to four exemplars: the tables have none of their own, so the first candidate sentences are taken."""
    docs = t(spark, d, "documents")
    first = m.exception_candidates(docs, "doc_id", "text", LATIN).orderBy("doc_id", "pos").limit(4).collect()  # as many as there are exemplars
    return m.exception_similarity(docs, "doc_id", "text", LATIN, [r["sentence"] for r in first] or ["-"])


def _tag(token):
    return F.when(token.endswith("ing"), "VA").otherwise("NNG")


def _vague(spark: SparkSession, d: str) -> DataFrame:
    return m.vague_terms(t(spark, d, "documents"), "doc_id", "text", LATIN, _tag)


_RULE_SQL = [f"count(*) FILTER ({f"starts_with(w, '{p}')" if kind == START else f"w = '{p}'"}{" AND ends_with(w, 'ing')" if tag else ''})" for _, kind, p, tag in LATIN.of_kind(START, EXACT)]
_TOKEN_NAMES = [n for n, *_ in LATIN.of_kind(START, EXACT)]
_VAGUE_SQL = rf"""
WITH w AS (SELECT doc_id, unnest(regexp_extract_all(text, '{WORD}')) AS w FROM documents),
r AS (SELECT doc_id, {', '.join(f'{c} AS "{n}"' for c, n in zip(_RULE_SQL, _TOKEN_NAMES))} FROM w GROUP BY doc_id),
p AS (SELECT doc_id, {', '.join(f"CAST(len(regexp_extract_all(regexp_replace(text, '{chr(92)}s+', ' ', 'g'), '{pat}')) AS BIGINT)" + f' AS "{n}"' for n, _, pat, _ in LATIN.of_kind(PHRASE))} FROM documents),
v AS (SELECT p.doc_id, {', '.join(f'coalesce("{n}", 0) AS "{n}"' for n in LATIN.rule_names)} FROM p LEFT JOIN r USING (doc_id))
"""


@query(_VAGUE_SQL + f"""SELECT *, {' + '.join(f'"{n}"' for n in LATIN.rule_names)} AS total FROM v""")
def vague_term_wide(spark: SparkSession, d: str) -> DataFrame:
    return _vague(spark, d)


@query(_VAGUE_SQL + " UNION ALL ".join(f"""SELECT '{n}' AS term, CAST(sum("{n}") AS BIGINT) AS total FROM v""" for n in LATIN.rule_names))
def vague_term_totals(spark: SparkSession, d: str) -> DataFrame:
    return m.vague_totals(_vague(spark, d), LATIN.rule_names)


@query(_VAGUE_SQL + "SELECT '{' || " + " || ',' || ".join(f"""'"{n}":' || CAST(sum("{n}") AS BIGINT)""" for n in LATIN.rule_names) + " || '}' AS json FROM v")
def term_totals_json(spark: SparkSession, d: str) -> DataFrame:
    return sinks.totals_json(_vague(spark, d), LATIN.rule_names)


def _foreign(spark: SparkSession, d: str) -> DataFrame:
    vocabulary = t(spark, d, "benchmark").select(F.explode(tx.words(F.col("text"))).alias("word"))
    return m.token_counts(t(spark, d, "documents"), "doc_id", "text", vocabulary)


_FOREIGN_SQL = rf"""
WITH v AS (SELECT DISTINCT unnest(regexp_extract_all(text, '{WORD}')) AS token FROM benchmark),
w AS (SELECT doc_id, unnest(x) AS token, generate_subscripts(x, 1) - 1 AS pos FROM (SELECT doc_id, regexp_extract_all(text, '{WORD}') AS x FROM documents)),
c AS (SELECT doc_id, token, count(*) AS n, CAST(min(pos) AS BIGINT) AS first_pos FROM w JOIN v USING (token) GROUP BY doc_id, token),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first_pos) AS rank FROM c)
"""


@query(_FOREIGN_SQL + ", g AS (SELECT doc_id, CAST(sum(n) AS BIGINT) AS total, count(*) AS uniq, string_agg(CASE WHEN rank <= 10 THEN token || ':' || n END, ', ' ORDER BY rank) AS top FROM k GROUP BY doc_id) SELECT d.doc_id, coalesce(total, 0) AS total, coalesce(uniq, 0) AS uniq, coalesce(top, '') AS top FROM documents d LEFT JOIN g USING (doc_id)")
def foreign_word_counts(spark: SparkSession, d: str) -> DataFrame:
    return m.token_summary(t(spark, d, "documents"), "doc_id", _foreign(spark, d))


@query(_FOREIGN_SQL + "SELECT doc_id, token, n, CAST(rank AS BIGINT) AS rank FROM k WHERE rank <= 10")
def foreign_top10(spark: SparkSession, d: str) -> DataFrame:
    order = Window.partitionBy("doc_id").orderBy(F.desc("n"), "first_pos")
    return _foreign(spark, d).withColumn("rank", F.row_number().over(order).cast("long")).filter("rank <= 10").select("doc_id", "token", "n", "rank")


@query(_FOREIGN_SQL + """SELECT doc_id, '{' || string_agg('"' || token || '":' || n, ',' ORDER BY token) || '}' AS counts_json FROM c GROUP BY doc_id""")
def counts_json(spark: SparkSession, d: str) -> DataFrame:
    return m.counts_json(_foreign(spark, d), "doc_id")


@query(
    rf"""
WITH {SENTENCES},
lex AS (SELECT DISTINCT w AS word, CAST(length(w) % 5 + 1 AS DOUBLE) AS grade FROM (SELECT unnest(regexp_extract_all(text, '{WORD}')) AS w FROM benchmark)),
n AS (SELECT doc_id, count(*) AS n_sentences FROM sent GROUP BY doc_id),
g AS (SELECT doc_id, count(*) AS n_matched, round(avg(grade), 6) AS avg_grade FROM (SELECT doc_id, unnest(regexp_extract_all(s, '{WORD}')) AS word FROM sent) JOIN lex USING (word) GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_sentences, 0) AS n_sentences, coalesce(n_matched, 0) AS n_matched, avg_grade FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN g USING (doc_id)
"""
)
def vocab_grade(spark: SparkSession, d: str) -> DataFrame:
    lexicon = t(spark, d, "benchmark").select(F.explode(tx.words(F.col("text"))).alias("word")).distinct().withColumn("grade", (F.length("word") % 5 + 1).cast("double"))
    out = m.vocabulary_grade(t(spark, d, "documents"), "doc_id", "text", lexicon, LATIN)
    return out.withColumn("avg_grade", F.round("avg_grade", 6))


_SENSE_CLASS = "CASE WHEN ends_with({w}, 'ing') THEN '동사' WHEN ends_with({w}, 'ly') THEN '형용사' ELSE '명사' END"


@query(
    rf"""
WITH {SENTENCES},
sent2 AS (SELECT doc_id, s, row_number() OVER () AS sid FROM sent),
w AS (SELECT DISTINCT unnest(regexp_extract_all(text, '{WORD}')) AS word FROM benchmark),
lex AS (SELECT word, {_SENSE_CLASS.format(w="word")} AS pos, k AS sense_ord, CAST((length(word) + 2 * k) % 5 + 1 AS DOUBLE) AS grade, (length(word) * (k + 1)) % 7 AS gloss FROM w, range(3) r(k) WHERE k <= length(word) % 3),
tok AS (SELECT doc_id, sid, length(s) AS n, unnest(x) AS word, generate_subscripts(x, 1) AS place FROM (SELECT *, regexp_extract_all(s, '{WORD}') AS x FROM sent2)),
c AS (SELECT doc_id, sid, place, sense_ord, grade, ((n + gloss) % 10) / 10.0 AS sim FROM tok JOIN lex ON lex.word = tok.word AND lex.pos = {_SENSE_CLASS.format(w="tok.word")}),
r AS (SELECT *, count(*) OVER p AS k, max(sim) OVER p AS best, row_number() OVER (PARTITION BY doc_id, sid, place ORDER BY sim DESC, sense_ord) AS by_sim, row_number() OVER (PARTITION BY doc_id, sid, place ORDER BY sense_ord) AS by_ord FROM c WINDOW p AS (PARTITION BY doc_id, sid, place)),
g AS (SELECT doc_id, count(*) AS n_matched, round(avg(grade), 6) AS avg_grade FROM r WHERE CASE WHEN k = 1 OR best < 0.45 THEN by_ord = 1 ELSE by_sim = 1 END GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n_sentences FROM sent GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_sentences, 0) AS n_sentences, coalesce(n_matched, 0) AS n_matched, avg_grade FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN g USING (doc_id)
"""
)
def vocab_senses(spark: SparkSession, d: str) -> DataFrame:
    """Up to three senses for each (word, class); their similarity to a sentence is a rule on lengths, with ties."""
    word = F.col("word")
    words = t(spark, d, "benchmark").select(F.explode(tx.words(F.col("text"))).alias("word")).distinct()
    senses = words.select("word", sc.tag_class(_sense_tag(word)).alias("pos"), F.explode(F.sequence(F.lit(0), F.length("word") % 3)).alias("sense_ord"))
    lexicon = senses.withColumn("grade", ((F.length("word") + 2 * F.col("sense_ord")) % 5 + 1).cast("double")).withColumn("gloss", (F.length("word") * (F.col("sense_ord") + 1)) % 7)
    tokens = lambda s: F.transform(tx.words(s), lambda w: F.struct(w.alias("form"), _sense_tag(w).alias("tag")))
    out = m.vocabulary_grade(t(spark, d, "documents"), "doc_id", "text", lexicon, LATIN, tokens, lambda s, gloss: ((F.length(s) + gloss) % 10) / 10)
    return out.withColumn("avg_grade", F.round("avg_grade", 6))


@query(
    rf"""
WITH {SENTENCES},
sent2 AS (SELECT doc_id, s, row_number() OVER () AS sid FROM sent),
i AS (SELECT item_id, regexp_extract_all(text, '{WORD}') AS ws FROM benchmark),
u AS (SELECT DISTINCT unnest(ws) AS word, item_id FROM i),
ranked AS (SELECT word, item_id, row_number() OVER (PARTITION BY word ORDER BY item_id) - 1 AS sense_ord FROM u QUALIFY sense_ord < 3),
lex AS (SELECT word, sense_ord, CAST((length(word) + 2 * sense_ord) % 5 + 1 AS DOUBLE) AS grade, {_BUCKETS} AS gloss FROM (SELECT ranked.*, {_POINTS.format("array_to_string(ws, ' ')")} AS cp FROM ranked JOIN i USING (item_id))),
sb AS (SELECT doc_id, sid, s, {_BUCKETS} AS b FROM (SELECT *, {_POINTS.format("s")} AS cp FROM sent2)),
tok AS (SELECT doc_id, sid, b, unnest(x) AS word, generate_subscripts(x, 1) AS place FROM (SELECT *, regexp_extract_all(s, '{WORD}') AS x FROM sb)),
c AS (SELECT doc_id, sid, place, sense_ord, grade, len(list_intersect(b, gloss)) / sqrt(CAST(len(b) AS DOUBLE) * len(gloss)) AS sim FROM tok JOIN lex USING (word)),
r AS (SELECT *, count(*) OVER p AS k, max(sim) OVER p AS best, row_number() OVER (PARTITION BY doc_id, sid, place ORDER BY sim DESC, sense_ord) AS by_sim, row_number() OVER (PARTITION BY doc_id, sid, place ORDER BY sense_ord) AS by_ord FROM c WINDOW p AS (PARTITION BY doc_id, sid, place)),
g AS (SELECT doc_id, count(*) AS n_matched, round(avg(grade), 6) AS avg_grade FROM r WHERE CASE WHEN k = 1 OR best < 0.2 THEN by_ord = 1 ELSE by_sim = 1 END GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n_sentences FROM sent GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_sentences, 0) AS n_sentences, coalesce(n_matched, 0) AS n_matched, avg_grade FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN g USING (doc_id)
"""
)
def gloss_similarity(spark: SparkSession, d: str) -> DataFrame:
    """Senses told apart by the encoder's similarity of sentence and gloss (a benchmark text that has the word, up to three)."""
    ship_package(spark)
    items = t(spark, d, "benchmark").select("item_id", tx.words(F.col("text")).alias("ws"))
    order = Window.partitionBy("word").orderBy("item_id")
    ranked = items.select("item_id", "ws", F.explode(F.array_distinct("ws")).alias("word")).withColumn("sense_ord", F.row_number().over(order) - 1).filter("sense_ord < 3")
    senses = ranked.select("word", "sense_ord", ((F.length("word") + 2 * F.col("sense_ord")) % 5 + 1).cast("double").alias("grade"), F.col("item_id").alias("gloss_id"))
    used = items.join(ranked.select("item_id").distinct(), "item_id", "left_semi")
    texts = used.select(F.col("item_id").alias("gloss_id"), encoder.buckets(F.array_join("ws", " ")).cast("array<int>").alias("numbers"))
    out = gl.gloss_grade(t(spark, d, "documents"), "doc_id", "text", senses, texts, LATIN, threshold=0.2)
    return out.withColumn("avg_grade", F.round("avg_grade", 6))


def _sense_tag(word):
    return F.when(word.endswith("ing"), "VV").when(word.endswith("ly"), "VA").otherwise("NNG")


def _first_vectors(spark: SparkSession, d: str, n: int) -> list[list[float]]:
    """The first vectors by id: as many as there are exemplars."""
    return [list(r["embedding"]) for r in t(spark, d, "embeddings").orderBy("vec_id").limit(n).collect()]


@query(
    """
WITH f AS (SELECT embedding AS e FROM embeddings ORDER BY vec_id LIMIT 1),
s AS (SELECT label, vec_id, vec_id % 7 AS grade, list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(e AS DOUBLE[])) AS sim FROM embeddings, f),
a AS (SELECT label, count(*) AS n, max(sim) AS best, arg_max(grade, sim) AS by_sim, arg_min(grade, vec_id) AS first_grade FROM s GROUP BY label)
SELECT CAST(label AS BIGINT) AS label, CASE WHEN n = 1 OR best < 0.45 THEN first_grade ELSE by_sim END AS grade FROM a
"""
)
def sense_argmax(spark: SparkSession, d: str) -> DataFrame:
    first = _first_vectors(spark, d, 1)
    candidates = t(spark, d, "embeddings").select(F.col("label").cast("long").alias("label"), F.col("vec_id").alias("sense_ord"), (F.col("vec_id") % 7).alias("grade"), vec.max_cosine(F.col("embedding"), first).alias("sim"))
    return m.pick_senses(candidates, ["label"])


@query(
    """
WITH f AS (SELECT embedding AS e FROM embeddings ORDER BY vec_id LIMIT 4)
SELECT vec_id, round(max(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(e AS DOUBLE[]))), 6) AS sim, max(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(e AS DOUBLE[]))) > 0.45 AS similar FROM embeddings, f GROUP BY vec_id
"""
)
def exemplar_similarity(spark: SparkSession, d: str) -> DataFrame:
    sim = vec.max_cosine(F.col("embedding"), _first_vectors(spark, d, 4))
    return t(spark, d, "embeddings").select("vec_id", F.round(sim, 6).alias("sim"), (sim > 0.45).alias("similar"))


@query(r"WITH l AS (SELECT doc_id, regexp_replace(unnest(string_split(text, chr(10))), '^\s+|\s+$', '', 'g') AS value FROM documents) SELECT doc_id, value FROM l WHERE value <> ''")
def id_list_clean(spark: SparkSession, d: str) -> DataFrame:
    opened = t(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return opened.select("doc_id", tx.trim_blanks(F.col("line")).alias("value")).filter("value <> ''")


@query("WITH r AS (SELECT p_partkey, p_brand, p_type, p_name, CASE WHEN p_partkey % 11 <> 0 THEN p_size || '등급' ELSE '미정' END AS g FROM part) SELECT p_name AS word, p_brand AS pos, p_type AS gloss, CAST(nullif(regexp_extract(g, '(\\d+)', 1), '') AS DOUBLE) AS grade, p_partkey AS sense_ord FROM r WHERE p_partkey % 11 <> 0 AND p_name IS NOT NULL AND p_brand IS NOT NULL AND p_type IS NOT NULL")
def lexicon_clean(spark: SparkSession, d: str) -> DataFrame:
    raw = t(spark, d, "part").withColumn("g", F.when(F.col("p_partkey") % 11 != 0, F.concat(F.col("p_size").cast("string"), F.lit("등급"))).otherwise("미정"))
    return clean_lexicon(raw, "p_name", "p_brand", "p_type", "g", "p_partkey")


@query(rf"WITH w AS (SELECT unnest(regexp_extract_all(text, '{WORD}')) AS token FROM documents), g AS (SELECT token, CASE WHEN ends_with(token, 'ing') THEN 'VV' WHEN ends_with(token, 'ly') THEN 'VA' WHEN ends_with(token, 's') THEN 'NNG' WHEN ends_with(token, 'x') THEN 'XSN' WHEN length(token) = 1 THEN 'NR' ELSE 'MM' END AS tag FROM w), c AS (SELECT *, CASE WHEN tag LIKE 'NN%' THEN '명사' WHEN tag LIKE 'VV%' THEN '동사' WHEN tag LIKE 'VA%' THEN '형용사' WHEN tag LIKE 'XSN%' THEN '접미사' WHEN tag = 'NR' THEN '수사' ELSE '기타' END AS cls FROM g) SELECT cls, count(*) AS n, count(DISTINCT token) AS uniq FROM c WHERE cls IN ('명사', '동사', '형용사', '접미사') GROUP BY cls")
def token_filters(spark: SparkSession, d: str) -> DataFrame:
    tokens = t(spark, d, "documents").select(F.explode(tx.words(F.col("text"))).alias("token"))
    k = F.col("token")
    tag = F.when(k.endswith("ing"), "VV").when(k.endswith("ly"), "VA").when(k.endswith("s"), "NNG").when(k.endswith("x"), "XSN").when(F.length(k) == 1, "NR").otherwise("MM")
    kept = tokens.withColumn("cls", sc.tag_class(tag)).filter(F.col("cls").isin("명사", "동사", "형용사", "접미사"))
    return kept.groupBy("cls").agg(F.count("*").alias("n"), F.countDistinct("token").alias("uniq"))


@query(rf"SELECT token, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '{WORD}')) AS token FROM documents) GROUP BY token ORDER BY n DESC, token LIMIT 10")
def global_top10(spark: SparkSession, d: str) -> DataFrame:
    tokens = t(spark, d, "documents").select(F.explode(tx.words(F.col("text"))).alias("token"))
    return tokens.groupBy("token").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "token").limit(10)


@query(rf"""WITH a AS (SELECT unnest(regexp_extract_all(text, '{WORD}')) AS term FROM documents), b AS (SELECT unnest(regexp_extract_all(text, 'of\s*the')) AS term FROM documents) SELECT term, count(*) AS n FROM (SELECT term FROM a UNION ALL SELECT regexp_replace(term, '\s+', ' ', 'g') FROM b) GROUP BY term""")
def counter_merge(spark: SparkSession, d: str) -> DataFrame:
    docs = t(spark, d, "documents")
    words = docs.select(F.explode(tx.words(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    phrases = docs.select(F.explode(F.regexp_extract_all("text", F.lit(r"of\s*the"), F.lit(0))).alias("x")).groupBy(tx.collapse_blanks(F.col("x")).alias("term")).agg(F.count("*").alias("n"))
    return words.union(phrases).groupBy("term").agg(F.sum("n").alias("n"))


@query(r"SELECT conv_id, turn, regexp_replace(text, '\s+', ' ', 'g') AS text FROM conversations")
def whitespace_collapse(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "conversations").select("conv_id", "turn", tx.collapse_blanks(F.col("text")).alias("text"))


@query("SELECT doc_id, nfc_normalize(text) AS text FROM documents")  # the tables hold no compatibility characters: there both forms are one
def nfkc_normalize(spark: SparkSession, d: str) -> DataFrame:
    ship_package(spark)
    return t(spark, d, "documents").select("doc_id", tx.nfkc(F.col("text")).alias("text"))


@query("SELECT doc_id, CAST(regexp_extract('[' || doc_id || '] x', '\\[(\\d+)\\]', 1) AS BIGINT) AS bracket_id, translate('[' || doc_id || '] x', '[]', '') AS bare FROM documents")
def bracket_strip(spark: SparkSession, d: str) -> DataFrame:
    name = F.concat(F.lit("["), F.col("doc_id").cast("string"), F.lit("] x"))
    return t(spark, d, "documents").select("doc_id", sc.bracket_id(name, anchored=True).alias("bracket_id"), F.translate(name, "[]", "").alias("bare"))


@query()
def morpheme_counts(spark: SparkSession, d: str) -> DataFrame:
    """Morphemes of every document: benchmark words as stems, a few endings, other words unknown."""
    ship_package(spark)
    stems = t(spark, d, "benchmark").select(F.explode(tx.words(F.col("text"))).alias("form")).groupBy("form").agg(F.lit("NNG").alias("tag"), F.count("*").alias("count"))
    endings = spark.createDataFrame([(x, "EC", 20) for x in ("ing", "s", "er", "ly", "able", "tion")], "form string, tag string, count long")
    pairs = {(mo.START, "NNG"): 0.2, ("NNG", mo.END): 0.7, ("NNG", "EC"): 1.0, ("NNG", "NNG"): 3.0, ("EC", mo.END): 0.3, (mo.START, "SL"): 1.0, ("SL", mo.END): 0.1, (mo.START, "SN"): 1.0, ("SN", mo.END): 0.1}
    found = mo.tokens_of(t(spark, d, "documents"), "doc_id", "text", mo.Model(mo.surfaces(stems.unionByName(endings)), pairs))
    of = lambda tag: F.coalesce(F.sum(F.when(F.col("tag") == tag, F.col("n"))), F.lit(0))
    counts = found.groupBy("doc_id").agg(of("NNG").alias("n_stems"), of("EC").alias("n_endings"), of("SL").alias("n_unknown"), F.count("*").alias("n_distinct"))
    return t(spark, d, "documents").select("doc_id").join(counts, "doc_id", "left").na.fill(0)


@query("SELECT doc_id, lang, source, n_chars FROM documents ORDER BY doc_id LIMIT 5")
def table_preview(spark: SparkSession, d: str) -> DataFrame:
    """The first rows of a table, as a reader looks at it."""
    return t(spark, d, "documents").select("doc_id", "lang", "source", "n_chars").orderBy("doc_id").limit(5)
