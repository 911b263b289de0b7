"""Every registered query against its SQL in DuckDB, and properties of plans."""

import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from draftmetrics import catalogue
from draftmetrics.functions.profiles import LATIN
from draftmetrics.operators import metrics as m

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        path = f"{sf}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    return f"{v:.6g}" if isinstance(v, float) else str(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_sql(spark, duck, sf, name):
    df = catalogue.queries()[name](spark, sf)
    result = duck.sql(catalogue.oracle_sql()[name])
    assert sorted(df.columns) == sorted(result.columns)
    assert rows(df.columns, df.collect()) == rows(result.columns, result.fetchall())


@pytest.mark.parametrize("name", ["page_sections", "labelled_pairs", "nfkc_normalize"])
def test_query_without_sql_has_rows(spark, sf, name):
    assert catalogue.queries()[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def plan(df):
    return df._jdf.queryExecution().toString()


def test_no_python_in_sql_queries(spark, sf):
    for name in ("sentence_length_metric", "vague_term_wide", "foreign_word_counts", "page_links", "corr_matrix", "stratified_split"):
        assert not any(x in plan(catalogue.queries()[name](spark, sf)) for x in ("BatchEvalPython", "ArrowEvalPython", "MapInArrow"))


def test_scan_reads_needed_columns_and_small_side_is_broadcast(spark, sf):
    p = plan(catalogue.queries()["avg_seniority"](spark, sf))
    assert "ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint>" in p and "BroadcastHashJoin" in p


def test_keyword_filter_reaches_the_scan(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    p = plan(m.exception_candidates(docs, "doc_id", "text", LATIN).filter(F.col("pos") >= 0))
    assert "StringContains(text" in p or "Contains(text" in p
