"""Token counts against the library's own ids."""

import random

import pytest
from tokenizers import Tokenizer

pytest.importorskip("draftmetrics.llm")

from draftmetrics.llm import queries, token_counts

SCHEMA = "doc_id long, text string, words string, block long"
ODD = ["", None, " ", "a\n", " a b", "a  b", "a\n\nb", "a \n b", "tab\there it's don't 'S we'll", "<|endoftext|> x", "x<|endoftext|><|endoftext|>y <|endoftext", "Ünḯ ΣΑΣ ΑΣ", "x\r\ny z", "a\x1cb\x85c d", "é ́a b", "İs x", "日本語 のテキスト 12345", "a!!\nb%%% c.", "　x y", "𝒜𝓑 🙂🙂 ok"]


def expected(text, file="byte_bpe_50k.json"):
    return len(Tokenizer.from_file(queries.tokenizer_path(file)).encode(text or "", add_special_tokens=False).ids)


def counts(spark, texts, file="byte_bpe_50k.json", **more):
    docs = spark.createDataFrame([(k, t, "w", 1) for k, t in enumerate(texts)], SCHEMA)
    return {r.doc_id: (r.n_bytes, r.n_tokens) for r in token_counts.count_tokens(docs, queries.tokenizer_path(file), **more).collect()}


@pytest.mark.parametrize("file,block", [("byte_bpe_50k.json", 1), ("byte_bpe_50k.json", 1 << 22), ("word_bpe_49k.json", 1 << 22)])
def test_counts_equal_the_library(spark, sf, file, block):
    plain = Tokenizer.from_file(queries.tokenizer_path(file))
    texts = ODD + [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").limit(60).collect()]
    got = counts(spark, texts, file, block_bytes=block)
    for k, text in enumerate(texts):
        assert got[k] == (len((text or "").encode()), len(plain.encode(text or "", add_special_tokens=False).ids)), text


def test_random_texts_with_a_cache_that_is_full(monkeypatch):
    monkeypatch.setattr(token_counts, "STRETCH", 40)
    rng = random.Random(5)
    plain = Tokenizer.from_file(queries.tokenizer_path("byte_bpe_50k.json"))
    cutter = token_counts.PreTokens(queries.tokenizer_path("byte_bpe_50k.json"))
    parts = ["word", "İİ", "ŉx", "é", "12", "'s", "'", "!!", " ", "  ", "\n", "\t", " ", " ", "ab", "Z", "。", "<|endoftext|>", "🙂", "Été", "ŉ.", "ab,;", "$x", "x$", "ª%", "\x85", "\x1f", "᠎"]
    for k in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(40)))
        (numbers,), (known,) = cutter.of([text])
        n = known + sum(len(cutter._tok.model.tokenize(cutter.names[i])) for i in numbers)
        assert n == len(plain.encode(text, add_special_tokens=False).ids), repr(text)
        if k % 500 == 0:
            cutter.clear()


def test_edges(spark):
    path = queries.tokenizer_path("byte_bpe_50k.json")
    assert token_counts.count_tokens(spark.createDataFrame([], SCHEMA), path).collect() == []
    rows = [(None, "no id", "w", 1), (3, "same text", "w", 1), (3, "same text", "w", 1), (4, None, None, None), (5, "word " * 200_000, "w", 1), (6, "x" * 300_000, "w", 1)]
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_tokens) for r in token_counts.count_tokens(spark.createDataFrame(rows, SCHEMA), path).collect())
    assert got == sorted((d or 0, len((t or "").encode()), expected(t)) for d, t, _, _ in rows)
