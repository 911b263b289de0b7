"""Pages: titles, links, texts, sections, listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from draftmetrics.functions import dom
from draftmetrics.functions import html as h
from draftmetrics.functions import scalars as sc
from draftmetrics.session import ship_package

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def pages(spark: SparkSession, d: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{d}/pages.parquet")


def _element_sql(tag: str) -> str:
    return rf"nullif(regexp_replace(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>', 1), '(?s)<[^>]*>', '', 'g'), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g'), '')"


_TEXT_SQL = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g')"


@query(f"SELECT page_id, coalesce({_element_sql('h2')}, {_element_sql('h1')}, {_TEXT_SQL}) AS title FROM pages")
def page_title_fallback(spark: SparkSession, d: str) -> DataFrame:
    return pages(spark, d).select("page_id", h.first_of(F.col("html"), ("h3", "detailh3"), ("h2", None), ("h1", None)).alias("title"))


@query("""SELECT page_id, CAST(generate_subscripts(x, 1) - 1 AS BIGINT) AS pos, unnest(x) AS href FROM (SELECT page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) AS x FROM pages)""")
def page_links(spark: SparkSession, d: str) -> DataFrame:
    return pages(spark, d).select("page_id", F.posexplode(h.links(F.col("html"))).alias("pos", "href")).withColumn("pos", F.col("pos").cast("long"))


@query(f"SELECT page_id, length({_TEXT_SQL}) AS n_chars FROM pages")
def page_text_length(spark: SparkSession, d: str) -> DataFrame:
    return pages(spark, d).select("page_id", F.length(h.page_text(F.col("html"))).cast("long").alias("n_chars"))


@query()
def page_sections(spark: SparkSession, d: str) -> DataFrame:
    return h.sections(pages(spark, d), "page_id", "html", ("article", "nav", "footer"))


_DECODED = "replace(replace(replace(replace({}, '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&amp;', '&')"


@query(f"SELECT page_id AS id, {_DECODED.format(_element_sql('h1'))} AS value FROM pages WHERE {_element_sql('h1')} IS NOT NULL")
def page_selected(spark: SparkSession, d: str) -> DataFrame:
    return dom.selected(pages(spark, d), "page_id", "html", "h1")


@query()
def labelled_pairs(spark: SparkSession, d: str) -> DataFrame:
    return h.labelled_pairs(pages(spark, d), "page_id", "html", "h1", "p")


@query(r"SELECT page_id, CAST(nullif(regexp_extract(url, '/(\d+)', 1), '') AS BIGINT) AS bill_num, coalesce(nullif(regexp_extract(regexp_extract(url, '([^/]*)$', 1), '^\[(\d+)\]', 1), ''), regexp_replace(regexp_extract(url, '([^/]*)$', 1), '(.)\.[^.]*$', '\1')) AS stem FROM pages")
def bill_id_extract(spark: SparkSession, d: str) -> DataFrame:
    return pages(spark, d).select("page_id", sc.extract_number(F.col("url"), r"/(\d+)").alias("bill_num"), sc.file_id(F.col("url")).alias("stem"))


@query(r"SELECT page_id, unnest(range(1, n + 1)) AS page FROM (SELECT page_id, coalesce(CAST(nullif(regexp_extract(url, 'page=(\d+)', 1), '') AS BIGINT), 1) AS n FROM pages)")
def pagination_fanout(spark: SparkSession, d: str) -> DataFrame:
    n = h.total_pages(F.regexp_replace("url", r"page=(\d+)", r"fnSearch($1)"))
    return pages(spark, d).select("page_id", F.explode(F.sequence(F.lit(1).cast("long"), n)).alias("page"))


@query(r"SELECT page_id, 'https://example.org/view?' || concat_ws('&', 'lang=' || nullif(regexp_extract(url, '//[^/]*/([a-z]+)/', 1), ''), 'billNo=' || nullif(regexp_extract(url, '/(\d+)', 1), '')) AS built FROM pages")
def url_build(spark: SparkSession, d: str) -> DataFrame:
    url = F.col("url")
    return pages(spark, d).select("page_id", h.built_url("https://example.org/view", lang=sc.extract(url, r"//[^/]*/([a-z]+)/"), billNo=sc.extract(url, r"/(\d+)")).alias("built"))
