"""The pipeline stage by stage, and the subpackage's queries against their SQL."""

import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

pytest.importorskip("draftmetrics.llm")

import corpus_pipeline
from draftmetrics.llm import pii_feistel, queries
from test_llm_operators import DOCS, EDGE, brute_components, brute_contamination

STAGE = dict(corpus_pipeline.STAGES)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "embeddings", "sales", "client_changes"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    df = queries.queries()[name](spark, sf)
    result = con.sql(queries.oracle_sql()[name])
    assert sorted(df.columns) == sorted(result.columns)
    rows = lambda columns, data: sorted(tuple(str(r[columns.index(c)]) for c in sorted(columns)) for r in data)
    assert rows(df.columns, df.collect()) == rows(result.columns, result.fetchall())


def kept(spark, sf, until):
    """What the stages before ``until`` leave, each from its own rule by plain Python."""
    rows = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()
    names = [n for n, _ in corpus_pipeline.STAGES]
    for stage in names[: names.index(until)]:
        if stage == "language_id":
            rows = [r for r in rows if r.text and any(c.isalpha() for c in r.text)]
        elif stage == "near_duplicates":
            component = {int(i): int(c) for i, n, c in brute_components([(r.doc_id, r.text) for r in rows])}
            rows = [r for r in rows if component[r.doc_id] == r.doc_id]
        elif stage == "benchmark_decontamination":
            items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
            rows = [r for r in rows if not brute_contamination(r.text, items)[3]]
    return rows


@pytest.mark.parametrize("before,after", [("near_duplicates", "benchmark_decontamination"), ("benchmark_decontamination", "pii")])
def test_stage_keeps_what_the_rule_keeps(spark, sf, before, after):
    docs = spark.createDataFrame(kept(spark, sf, before), DOCS).withColumn("Row_Doc_Id", F.lit(1)).withColumn("contamination", F.lit("x"))
    got = STAGE[before](spark, docs, sf)
    assert got.columns == docs.columns
    expected = kept(spark, sf, after)
    assert len(expected) < docs.count()
    assert sorted((r.doc_id, r.text) for r in got.collect()) == sorted((r.doc_id, r.text) for r in expected)


def test_run_gives_every_id_of_what_is_kept(spark, sf):
    expected = kept(spark, sf, "pii")
    names, plain = pii_feistel.Pseudonyms(pii_feistel.session_key(spark)), Tokenizer.from_file(queries.tokenizer_path("word_bpe_49k.json"))
    pieces = {}
    rows = corpus_pipeline.run(spark, sf).collect()
    for r in sorted(rows, key=lambda r: r.start):
        pieces.setdefault(r.doc_id, []).append(r)
    assert set(pieces) == {r.doc_id for r in expected}
    for r in expected:
        ids = np.array([*plain.encode(pii_feistel.replace_all(r.text, names)[0], add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for p in pieces[r.doc_id]:
            assert (p.start, p.doc_tokens, p.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + p.length].tobytes()))
            at += p.length
        assert at == len(ids)
    filled = Counter()
    for r in rows:
        filled[r.sequence_id] += r.length
    assert all(n == 4096 or n & (n - 1) == 0 for n in filled.values())


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stage_on_edge_rows_and_an_empty_table(spark, sf, name):
    docs = spark.createDataFrame(EDGE, DOCS)
    for c in ("language", "Row_Key", "contamination", "PII", "sequence_id"):
        docs = docs.withColumn(c, F.lit(c))
    out = STAGE[name](spark, docs, sf)
    rows = out.collect()
    if name == "packing":
        assert sum(r.length for r in rows if r.doc_id == 1) == 1 and {r.doc_id for r in rows} == {r[0] for r in EDGE}
    else:
        assert out.columns == docs.columns
        ids = Counter(r.doc_id for r in rows)
        gone = {"language_id": [1, 2, 3, 8], "near_duplicates": [7]}.get(name, [])
        assert ids == Counter(r[0] for r in EDGE) - Counter(gone)
    assert STAGE[name](spark, docs.limit(0), sf).count() == 0


def test_private_values_of_kept_documents_are_replaced(spark, sf):
    docs = spark.createDataFrame([(1, "mail иван@example.com or 4111 1111 1111 1111", "en", "s", 5)], DOCS)
    row = STAGE["pii"](spark, docs, sf).first()
    assert "иван" not in row.text and "4111 1111" not in row.text and row.n_chars == len(row.text)
