"""The ten operators against brute force, round trips and edge cases."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

pytest.importorskip("draftmetrics.llm")

from draftmetrics.llm import decontaminate, huffman_store, jaccard_join, language_mixture, license_scan, media_ts, packing, pii_feistel, queries, shard_permutation, tokens, url_rules, wordhash
from draftmetrics.llm.components import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
EDGE = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, " \n\t ", "en", "s", 4), (None, "no id here at all", "en", "s", 17), (5, "é" * 3 + " word", "fr", None, 8), (6, "word " * 40_000, "en", "s", 200_000), (7, "same text twice in here", "en", "s", 23), (7, "same text twice in here", "en", "s", 23), (8, "123 !!! 456", "en", "s", 11)]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(EDGE, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def words8(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingles(text):
    w = words8(text)
    return frozenset(tuple(w[k : k + 4]) for k in range(len(w) - 3)) if len(w) >= 4 else frozenset([tuple(w)] if w else [])


# -- tokens and files ---------------------------------------------------------------------


@pytest.mark.parametrize("file", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_cached_tokenizer_equals_library(file, spark, sf):
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    texts += ["", None, " ", "a\n", " a b", "a  b", "a\n\nb", "a \n b", "tab\there it's don't 'S", "<|endoftext|> x", "Ünḯ ΣΑΣ ΑΣ", "\x01 a\x01b c", "x\r\ny z", "a\x1cb\x85c d", "é ́a b", "İs x", "a!!\nb%%% c.", "Straße, ªb º."]
    plain = Tokenizer.from_file(queries.tokenizer_path(file))
    for text, ids in zip(texts, tokens.WordCachedTokenizer(queries.tokenizer_path(file)).encode(texts)):
        assert ids.tolist() == (plain.encode(text, add_special_tokens=False).ids if text else [])


@pytest.mark.parametrize("file", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_do_not_depend_on_what_was_met_before(file):
    """Words that lower case, marks or combining characters change, with a cache that holds them bare, and with a fresh one."""
    plain = Tokenizer.from_file(queries.tokenizer_path(file))
    warm = tokens.WordCachedTokenizer(queries.tokenizer_path(file))
    rng = random.Random(11)
    stems = ["CUMHURİYETİ", "İ", "İstanbul", "ŉ", "Aŉ", "ǰ", "ß", "STRASSE", "é", "e\u0301", "i\u0307", "I\u0307", "ŀ", "Σ", "word", "DŽ", "ª", "Ⱥ", "ı"]
    texts = ["CUMHURİYETİ CUMHURİYETİ.", "İ İ,"]
    texts += [" ".join(rng.choice(stems) + rng.choice(["", "", ".", ",", "!!", "%", "'s", "\u0307"]) for _ in range(rng.randrange(1, 9))) for _ in range(1500)]
    warm.encode([" ".join(stems)])
    for k, text in enumerate(texts):
        want = plain.encode(text, add_special_tokens=False).ids
        assert warm.encode([text])[0].tolist() == want, text
        if k < 40:
            assert tokens.WordCachedTokenizer(queries.tokenizer_path(file)).encode([text])[0].tolist() == want, text


@pytest.mark.parametrize("file", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_added_tokens_are_encoded_as_by_a_plain_tokenizer(file):
    plain = Tokenizer.from_file(queries.tokenizer_path(file))
    special = [t.content for t in plain.get_added_tokens_decoder().values()]
    texts = ["x <|endoftext|> y", "<|endoftext|>", "a <|ENDOFTEXT|> b", "no special token here", *[f"word {s} word{s}\n{s}x" for s in special[:200]]]
    for text, ids in zip(texts, tokens.WordCachedTokenizer(queries.tokenizer_path(file)).encode(texts)):
        assert ids.tolist() == plain.encode(text, add_special_tokens=False).ids, text


def test_a_full_cache_keeps_what_is_used_most(spark, sf):
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    t, plain = tokens.WordCachedTokenizer(queries.tokenizer_path("byte_bpe_50k.json"), 500), Tokenizer.from_file(queries.tokenizer_path("byte_bpe_50k.json"))
    for k in range(0, len(texts), 5):
        for text, ids in zip(texts[k : k + 5], t.encode(texts[k : k + 5])):
            assert ids.tolist() == plain.encode(text, add_special_tokens=False).ids


def test_a_file_of_another_set_up_goes_to_the_library(tmp_path):
    import json

    with open(queries.tokenizer_path("word_bpe_49k.json")) as f:
        parts = json.load(f)
    parts["normalizer"] = {"type": "NFD"}  # upper case stays and accents come apart
    path = tmp_path / "other.json"
    path.write_text(json.dumps(parts))
    texts = ["Plain Words Here", "é à la carte", "x"]
    plain = Tokenizer.from_file(str(path))
    for text, ids in zip(texts, tokens.WordCachedTokenizer(str(path)).encode(texts)):
        assert ids.tolist() == plain.encode(text, add_special_tokens=False).ids


def test_length_limited_codes_are_optimal_and_decode():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 40, 700):
        counts = {int(i): int(c) for i, c in enumerate(rng.zipf(1.4, n) % 100_000 + 1)}
        lengths = huffman_store.code_lengths(counts, 12)
        assert lengths.max() <= 12 and (n == 1 or sum(2.0 ** -int(x) for x in lengths if x) == 1.0)
        ids = rng.choice(n, 5000).astype(np.uint32)
        blob = huffman_store.make_file([9], [ids], lengths, huffman_store.canonical_codes(lengths))
        docs, ends, back = huffman_store.read_file(blob)
        assert docs == [9] and (back == ids).all()


def test_token_store_roundtrip(spark, edge, empty):
    path = queries.tokenizer_path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    rows = sorted(huffman_store.store_roundtrip(edge.withColumn("n_tokens", F.lit(1)), path).collect(), key=lambda r: r.start)
    expected = sorted(EDGE, key=lambda r: (r[0] is not None, r[0] or 0))
    assert [r.doc_id for r in rows] == [r[0] for r in expected]
    start = 0
    for row, (_, text, *_) in zip(rows, expected):
        ids = np.array([*(t.encode(text, add_special_tokens=False).ids if text else []), 0], "<u4")
        assert (row.start, row.n_tokens, row.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert huffman_store.store_roundtrip(empty, path).count() == 0


def test_a_written_store_stays_and_reads_back(spark, edge, tmp_path):
    path = str(tmp_path / "store")
    ids = huffman_store.encode_tokens(edge, queries.tokenizer_path("byte_bpe_50k.json"), 0)
    assert huffman_store.write_store(ids, path) == path
    got = {r.start: (r.n_tokens, r.ids_crc32) for r in huffman_store.read_store(spark, path).collect()}
    assert len(got) == len(EDGE) and sum(n for n, _ in got.values()) == ids.agg(F.sum("n_tokens")).first()[0]


# -- packing -----------------------------------------------------------------------------


def test_packing_places_every_id_once(spark, edge, empty):
    path = queries.tokenizer_path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    rows = packing.pack(edge.withColumn("START", F.lit(1)), path, capacity=256, group_tokens=2000).collect()
    by_seq, by_doc = {}, {}
    for r in rows:
        by_seq.setdefault(r.sequence_id, []).append(r)
        by_doc.setdefault(r.doc_id, []).append(r)
    for pieces in by_seq.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at == 256 or at & (at - 1) == 0
    for doc, text, *_ in EDGE:
        if doc == 7:
            continue
        ids = np.array([*(t.encode(text, add_special_tokens=False).ids if text else []), 2], "<u4")
        at = 0
        for p in sorted(by_doc[doc], key=lambda p: p.start):
            assert (p.start, p.doc_tokens, p.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + p.length].tobytes()))
            at += p.length
        assert at == len(ids)
    assert packing.pack(empty, path).count() == 0


def test_what_a_group_leaves_over_is_carried_on(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").coalesce(1)
    rows = packing.pack(docs, queries.tokenizer_path("word_bpe_49k.json"), capacity=512, group_tokens=8000).collect()
    size = Counter()
    for r in rows:
        size[r.sequence_id] += r.length
        assert r.sequence_tokens >= r.offset + r.length
    short = [n for n in size.values() if n < 512]
    assert len(size) > 100 and all(n & (n - 1) == 0 for n in size.values()) and len(set(short)) == len(short)
    whole = {r.doc_id: 0 for r in rows}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
        assert r.start == whole[r.doc_id]
        whole[r.doc_id] += r.length
    assert all(whole[r.doc_id] == r.doc_tokens for r in rows)


def test_packing_balances_cost():
    rng = random.Random(3)
    lengths = [rng.randint(1, 900) for _ in range(2000)]
    pieces, filled = packing.place(lengths, 1024)
    cost = Counter()
    for _, _, n, q, _ in pieces:
        cost[q] += n + n * n / 1024
    full = [cost[q] for q, n in enumerate(filled) if n == 1024]
    assert max(full) < 1.5 * np.mean(full)


# -- sharding -----------------------------------------------------------------------------


def test_shards_are_a_permutation_and_independent_of_layout(spark, edge, empty):
    rows = shard_permutation.shard(edge, 4).collect()
    again = shard_permutation.shard(edge.repartition(7), 4).collect()
    key = lambda r: (str(r.doc_id), r.shard, r.slot)
    assert sorted(map(key, rows)) == sorted(map(key, again))
    sizes = Counter(r.shard for r in rows)
    assert max(sizes.values()) - min(sizes.values()) <= 1
    for s in sizes:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sizes[s]))
    for r in rows:
        text = next(t or "" for i, t, *_ in EDGE if i == r.doc_id)
        assert r.size == len(text.encode()) + 8 and r.text_crc32 == zlib.crc32(text.encode())
    assert shard_permutation.shard(empty, 4).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 5, 17, 100, 1000])
def test_feistel_permutes(spark, n):
    got = spark.range(n).select(shard_permutation.permuted(F.col("id"), n, 7).alias("p")).collect()
    assert sorted(r.p for r in got) == list(range(n))


def test_many_equal_rows_unfold(spark):
    docs = spark.range(25_000).select(F.lit(1).cast("long").alias("doc_id"), F.lit("x").alias("text"))
    out = shard_permutation.shard(docs, 8)
    assert out.select("shard", "slot").distinct().count() == 25_000


# -- URLs -------------------------------------------------------------------------------


def test_url_rules_against_plain_matching(spark):
    urls = [None, "", "no scheme", "http://EXAMPLE.com/en/1?x", "https://www.example.com/en/2#t", "http://a.example.com/de/", "http://x.net/es/1", "http://x.net/fr", "http://com", "http://com/", "http://notcom/", "http://x.com?/", "a://b://c.net/es/", "http://ünï.net/fr/é", "http://..net/es/"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)] + [(3, urls[3])], "page_id long, url string")
    rules = spark.createDataFrame(queries.URL_RULES, "host string, path string, action string")
    got = url_rules.judge_urls(pages, rules).collect()
    assert len(got) == len(urls) + 1
    for r in got:
        u = urls[r.page_id]
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = re.sub("[A-Z]", lambda m: m[0].lower(), re.match(r"[^/?#]*", rest)[0])
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        fits = [(len(h + p), h + p, a) for h, p, a in queries.URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule, verdict = max(fits)[1:] if fits else (None, "allow")
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, verdict)
    long = spark.createDataFrame([(1, "a://" + "a." * 100_000 + "com/en/")], "page_id long, url string")
    assert url_rules.judge_urls(long, rules).select("rule").first()[0] == "com/"
    twice = spark.createDataFrame([("com", "/", "allow"), ("com", "/", "block")], "host string, path string, action string")
    assert {r.verdict for r in url_rules.judge_urls(pages.filter("url LIKE 'http://com%'"), twice).collect()} == {"block", "allow"}
    assert url_rules.judge_urls(pages.limit(0).withColumn("row", F.lit(1)), rules).count() == 0
    none = spark.createDataFrame([], "host string, path string, action string")
    assert {r.verdict for r in url_rules.judge_urls(pages, none).collect()} == {"allow"}


# -- Jaccard ------------------------------------------------------------------------------


def brute_components(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 85 * len(x | y):
                parent[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(sets):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return sorted((str(i), len(s), str(least.get(find(k), i) if s else i)) for k, (i, s) in enumerate(sets))


def near_copies(seed, n, sizes):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(300)]
    out, texts = [], []
    for k in range(n):
        if texts and rng.random() < 0.6:
            w = rng.choice(texts).split()
            for _ in range(rng.randint(0, max(1, len(w) // 25))):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            if rng.random() < 0.3:
                w = w[: max(1, len(w) - rng.randint(0, len(w) // 12))]
            text = " ".join(w)
        else:
            text = " ".join(rng.choice(vocabulary) for _ in range(rng.choice(sizes)))
        texts.append(text)
        out.append((k, text))
    return out


@pytest.mark.parametrize("seed,sizes", [(1, [1, 2, 3, 4, 5, 8, 9, 10]), (2, [12, 20, 30, 45]), (3, [70, 100, 150, 220, 400])])
def test_jaccard_components_against_all_pairs(spark, seed, sizes):
    rows = near_copies(seed, 220, sizes)
    got = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == brute_components(rows)


@pytest.mark.parametrize("block", [8, 512])
def test_a_passage_that_many_documents_share(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    rng = random.Random(block)
    passage = [f"p{k}" for k in range(60)]
    rows = []
    for k in range(150):
        own = [f"v{rng.randint(0, 200)}" for _ in range(rng.choice([6, 9, 30, 60]))]
        at = rng.randrange(len(own) + 1)
        w = own[:at] + passage + own[at:]
        rows.append((2 * k, " ".join(w)))
        if rng.random() < 0.4:
            w[rng.randrange(len(w))] = "changed"
            rows.append((2 * k + 1, " ".join(w)))
    got = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == brute_components(rows)


def test_large_group_of_near_copies_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", 16)
    monkeypatch.setattr(jaccard_join, "PIVOT_CHUNK", 8)
    rng = random.Random(11)
    base = [f"b{k}" for k in range(150)]
    rows = []
    for k in range(160):
        w = list(base)
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = f"x{rng.randint(0, 400)}"
        rows.append((k, " ".join(w)))
    got = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    expected = brute_components(rows)
    assert len({c for _, _, c in expected}) > 5
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == expected


def test_jaccard_edge_cases(spark, edge, empty):
    got = jaccard_join.jaccard_components(edge).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == brute_components([(r[0], r[1]) for r in EDGE])
    assert jaccard_join.jaccard_components(empty).count() == 0
    kept = jaccard_join.keep_one(edge.withColumn("row_key", F.lit(1)))
    assert kept.columns == [*edge.columns, "row_key"]
    assert Counter(r.doc_id for r in kept.collect()) == Counter({None: 1, 1: 1, 2: 1, 3: 1, 5: 1, 6: 1, 7: 1, 8: 1})


def test_signatures_of_similar_sets_meet():
    rng = np.random.default_rng(5)
    for n in [6, 7, 9, 13, 14, 20, 29, 42, 61, 88, 90, 130, 200, 300, 411, 900]:
        for _ in range(40):
            base = rng.integers(0, 1 << 63, 2 * n, dtype=np.uint64)
            m = int(rng.integers(max(1, int(0.85 * n)), n + 1))
            k = -(-85 * (n + m) // 185)  # least intersection
            if k > m:
                continue
            a, b = np.unique(base[:n]), np.unique(np.concatenate([base[:k], base[n : n + m - k]]))
            if 100 * k < 85 * (n + m - k):
                continue
            assert (a.tolist() == b.tolist()) or np.intersect1d(jaccard_join.signatures(a, 85), jaccard_join.signatures(b, 85)).size


def test_sketches_reject_no_linked_pair():
    rng = np.random.default_rng(9)
    for n in (1, 3, 20, 90, 400, 1500):
        for _ in range(20):
            base = np.unique(rng.integers(0, 1 << 63, 2 * n, dtype=np.uint64))
            m = int(rng.integers(max(1, int(0.85 * n)), n + 1))
            k = int(rng.integers(0, m + 1))
            a, b = base[:n], np.sort(np.concatenate([base[:k], base[n : n + m - k]]))
            linked = 100 * k >= 85 * (n + m - k)
            ((close,),) = jaccard_join.close_by_sketch([(n, jaccard_join.sketch(a))], [(m, jaccard_join.sketch(b))], 85)
            assert close or not linked
            assert not close or k > 0.6 * n or n < 20  # most others are rejected


def test_sketches_differ_as_in_workers(spark):
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64)) for n in (40, 43, 85, 90, 171)]
    maps = [jaccard_join.sketch(s) for s in sets]
    df = spark.createDataFrame([(i, j, maps[i].tolist(), maps[j].tolist()) for i, j in ((0, 1), (1, 2), (2, 1), (3, 4), (3, 3))], "i int, j int, x array<long>, y array<long>")
    for r in df.withColumn("d", jaccard_join.sketches_differ(F.col("x"), F.col("y"))).collect():
        n = 64 * min(len(r.x), len(r.y))
        fold = [np.bitwise_xor.reduce(np.unpackbits(maps[k].view(np.uint8), bitorder="little").reshape(-1, n)) for k in (r.i, r.j)]
        assert r.d == int((fold[0] != fold[1]).sum())


def test_long_words_with_equal_polynomials_differ():
    thue = [bin(k).count("1") & 1 for k in range(2048)]
    for n in (64, 1024, 2048):
        one, other = ("".join("ab"[x ^ flip] for x in thue[:n]) for flip in (0, 1))
        hashes, _ = wordhash.hash_words([f"{one} {other} {one}"], jaccard_join.WORDS)
        assert hashes[0] == hashes[2] != hashes[1]


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (5, 4), (6, 4), (7, 8), (3, 9), (9, 9)], "u long, v long")
    assert {r.node: r.label for r in components(edges).collect()} == {1: 1, 2: 1, 3: 1, 9: 1, 4: 4, 5: 4, 6: 4, 7: 7, 8: 7}


# -- contamination -------------------------------------------------------------------------


def words10(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_contamination(text, items):
    w, hit, found = words10(text), set(), set()
    for i, t in items:
        x = words10(t)
        if not x:
            continue
        n = min(13, len(x))
        windows = {tuple(x[k : k + n]) for k in range(len(x) - n + 1)}
        at = [k for k in range(len(w) - n + 1) if tuple(w[k : k + n]) in windows]
        hit.update(p for k in at for p in range(k, k + n))
        if at and i is not None:
            found.add(str(i))
    return len(w), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(w)


def contamination_case(seed):
    rng = random.Random(seed)
    v = [f"t{k}" for k in range(12)]
    items = [(k, " ".join(rng.choice(v) for _ in range(rng.choice([0, 1, 3, 12, 13, 14, 30])))) for k in range(12)] + [(None, "zz yy"), (3, "again a item"), (99, None)]
    docs = []
    for k in range(60):
        w = [rng.choice(v) for _ in range(rng.randint(0, 40))]
        if rng.random() < 0.6:
            x = rng.choice(items)[1] or ""
            w[len(w) // 2 : len(w) // 2] = x.upper().split()
        docs.append((k, ", ".join(w)))
    return docs + [(100, None), (101, ""), (102, "..."), (103, "zz yy")], items


@pytest.mark.parametrize("seed,block", [(1, None), (2, 60)])
def test_contamination_against_brute_force(spark, monkeypatch, seed, block):
    if block:
        monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
    docs, items = contamination_case(seed)
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("contamination", F.lit(0))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: r.c for r in decontaminate.find_contamination(df, bench, name="c").collect()}
    for i, text in docs:
        c = got[i]
        assert (c.n_words, c.n_hit, c["items"], c.contaminated) == brute_contamination(text, items), (i, text)


def longest_by_hand(text, items):
    w, best = words10(text), 0
    for x in (words10(t) for _, t in items):
        for a in range(len(w)):
            for b in range(len(x)):
                k = 0
                while a + k < len(w) and b + k < len(x) and w[a + k] == x[b + k]:
                    k += 1
                best = max(best, k)
    return best


@pytest.mark.parametrize("seed,piece", [(3, 1 << 18), (4, 40)])
def test_matches_and_their_length_against_all_positions(monkeypatch, seed, piece):
    monkeypatch.setattr(decontaminate, "SHARD_WORDS", piece)
    docs, items = contamination_case(seed)
    found = decontaminate.match([t for _, t in docs], decontaminate.Benchmark([(None if i is None else str(i), t) for i, t in items]))
    for (_, text), (n, flags, ids, longest, spans) in zip(docs, found):
        assert (n, int(flags.sum()), sorted(ids)) == brute_contamination(text, items)[:3] and longest == longest_by_hand(text, items)
        assert sum(k for _, k in spans) == flags.sum()


def test_one_word_repeated_very_often():
    ((n, flags, ids, longest, spans),) = decontaminate.match(["a " * 100_000], decontaminate.Benchmark([("1", "a " * 3000)]))
    assert (n, flags.all(), ids, longest, spans) == (100_000, True, {"1"}, 3000, [(0, 100_000)])


def test_suffix_array_orders_all_suffixes():
    rng = np.random.default_rng(2)
    for letters in (1, 2, 5):
        counts = rng.integers(0, 30, 9)
        words = rng.integers(0, letters, counts.sum()).astype(np.uint64)
        array = decontaminate.SuffixArray(words, counts, 4)
        text = array.text.tolist()
        assert array.order.tolist() == sorted(range(len(text)), key=lambda k: text[k:])


def test_longest_match_and_empty_benchmark(spark, edge):
    item = " ".join(f"q{k}" for k in range(20))
    docs = spark.createDataFrame([(1, "x " + item + " y"), (2, " ".join(f"q{k}" for k in range(2, 17)))], "doc_id long, text string")
    got = {r.doc_id: r.c for r in decontaminate.find_contamination(docs, spark.createDataFrame([(1, item)], "item_id long, text string"), name="c").collect()}
    assert got[1].longest_match_words == 20 and got[1].span_start == [1] and got[2].longest_match_words == 15
    none = decontaminate.find_contamination(edge, spark.createDataFrame([], "item_id long, text string"), name="c")
    assert none.filter("c.contaminated").count() == 0


# -- languages ----------------------------------------------------------------------------


def test_language_held_out_accuracy(spark, sf):
    out = queries.op2_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert np.mean([r.lang_pred == r.lang for r in out]) > 0.97


def test_language_mixture_and_edges(spark, edge, empty, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = language_mixture.train(docs)
    text = {lang: " ".join(r.text for r in docs.filter(F.col("lang") == lang).orderBy("doc_id").limit(8).collect())[:4000] for lang in ("en", "de")}
    (mix,) = model.mixture([text["en"] + " " + text["de"]])
    assert {x for x, _ in mix[:2]} == {"en", "de"} and abs(mix[0][1] - 0.5) < 0.15
    assert [x for x, _ in model.mixture([text["en"]])[0]][0] == "en"
    got = {r.doc_id: r.language for r in language_mixture.identify(edge, model).collect()}
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (1, 2, 3, 8)) and got[6].lang_pred != "und"
    none = language_mixture.train(empty)
    assert none.languages == () and language_mixture.identify(edge, none).filter("language.lang_pred <> 'und'").count() == 0
    assert language_mixture.identify(empty, model).count() == 0


def plain_mixture(model, text):
    """The same model by plain loops: units, EM over all sets of growing size."""
    import math

    bucket, _ = language_mixture._trigrams([text], model.bits)
    unit = [bucket[k : k + language_mixture.UNIT] for k in range(0, len(bucket), language_mixture.UNIT)]
    ll = [[float(sum(float(model.log_p[b, j]) for b in u)) * language_mixture.TEMPER for j in range(len(model.languages))] for u in unit]

    def em(allowed):
        pi = {j: 1 / len(allowed) for j in allowed}
        for _ in range(language_mixture.EM_ROUNDS):
            total = dict.fromkeys(allowed, 0.0)
            for row in ll:
                top = max(row[j] for j in allowed)
                r = {j: pi[j] * math.exp(row[j] - top) for j in allowed}
                for j in allowed:
                    total[j] += r[j] / sum(r.values())
            pi = {j: total[j] / len(ll) for j in allowed}
        like = sum(math.log(sum(pi[j] * math.exp(row[j] - max(row[i] for i in allowed)) for j in allowed)) + max(row[j] for j in allowed) for row in ll)
        return pi, like

    every = range(len(model.languages))
    single = [sum(row[j] for row in ll) for j in every]
    best = max(every, key=lambda j: (single[j], -j))
    share, _ = em(list(every))
    order = [best, *sorted((j for j in every if j != best), key=lambda j: (-share[j], j))]
    chosen, current = {best: 1.0}, single[best]
    for k in range(2, len(order) + 1):
        pi, like = em(order[:k])
        if like - current <= language_mixture.PENALTY + 0.5 * math.log(len(ll)):
            break
        chosen, current = pi, like
    return {model.languages[j]: p for j, p in chosen.items()}


def test_mixtures_against_plain_loops(spark, sf, monkeypatch):
    monkeypatch.setattr(language_mixture, "LOOKED_UP", 1000)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = language_mixture.train(docs)
    texts = [r.text[:900] for r in docs.orderBy("doc_id").limit(40).collect()]
    texts += [a + " " + b for a, b in zip(texts[::2], texts[1::2])]
    mixed = 0
    for text, got in zip(texts, model.mixture(texts)):
        expected = plain_mixture(model, text)
        mixed += len(expected) > 1
        assert dict(got).keys() == expected.keys() and all(abs(p - expected[x]) < 1e-4 for x, p in got)
    assert mixed > 3


# -- personal data ---------------------------------------------------------------------------


def test_pseudonyms_keep_format_and_restore():
    names, back = pii_feistel.Pseudonyms(b"k"), pii_feistel.Pseudonyms(b"k", True)
    text = 'a und.34@mail7.example.com b 233.254.104.120. c +1 (017) 555-7713 d 4111 1111 1111 1111 e 2021-03-04 f 31.12.1999 g 12/25/2001 h 123-45-6789 i DE89 3704 0044 0532 0130 00 j token = "9233a8ecf7c5b09fe5949719b6b82bc439e9329b" k'
    new, found = pii_feistel.replace_all(text, names)
    assert [k for k, _, _ in found] == ["email", "ip", "phone", "card", "iso_date", "day_date", "day_date", "ssn", "iban", "secret"]
    for old in ("und.34@", "233.254.104.120", "555-7713", "4111 1111", "2021-03-04", "31.12.1999", "12/25/2001", "123-45-6789", "3704 0044", "9233a8ecf7"):
        assert old not in new
    assert re.search(r"\+1 \(\d{3}\) \d{3}-\d{4}", new) and "@mail7.example.com" in new
    assert pii_feistel.restore_all(new, found, back) == text
    for kind, a, b in found:
        assert kind != "card" or pii_feistel.luhn_digit([int(c) for c in new[a:b] if c.isdigit()][:-1]) == int(new[a:b][-1])


def test_invalid_values_stay_and_equal_values_link(spark, edge, empty):
    names = pii_feistel.Pseudonyms(b"k")
    for text in ("number 4111111111111112 is no card", "1.2.3.456 or 1.2.3.4.5", "2021-02-30", "Version 2.0. and 3.14", "page 12", "a@b"):
        assert pii_feistel.replace_all(text, names) == (text, [])
    a, b = (pii_feistel.replace_all(f"{x} 9.8.7.6 {x}", names)[0] for x in ("p", "q"))
    assert a.split()[1] == b.split()[1]
    out = pii_feistel.pseudonymise(edge, b"k", name="f").collect()
    assert [r.text for r in sorted(out, key=lambda r: str(r.doc_id))] == [r[1] for r in sorted(EDGE, key=lambda r: str(r[0]))]
    assert pii_feistel.pseudonymise(empty, b"k").count() == 0


def test_a_value_has_one_pseudonym_beside_anything(spark):
    """The image is that of the value alone, in 1,500 surroundings in which a pseudonym may grow; texts come back by the report."""
    rng = random.Random(2)
    names, back = (pii_feistel.Pseudonyms(b"some key", b) for b in (False, True))
    mail = names.value("email", "anna.smith@example.com")
    texts = []
    for _ in range(1500):
        body = f"{rng.randrange(10**12):012d}{rng.randrange(10**6):06d}"
        check = 98 - int(f"{body}131400") % 97
        texts.append(f"anna.smith@example.com pays DE{check:02d}{body} {rng.randrange(10**4):04d} now, {rng.choice(['', '4111 1111 1111 1111 '])}2021-03-04")
    for text in texts:
        new, found = pii_feistel.replace_all(text, names)
        assert new.startswith(mail + " pays ") and pii_feistel.restore_all(new, found, back) == text
        at = text.index(" pays ") + 6
        value = text[at : at + 22]
        kind, a, b = found[1]
        assert kind == "iban" and (new[a:b] == names.value("iban", value) or text[at : at + 27] == new[:0] or b - a > 22)
    docs = spark.createDataFrame([(k, t) for k, t in enumerate([*texts[:50], None, ""])], "doc_id long, text string")
    hidden = pii_feistel.pseudonymise(docs, b"some key")
    assert hidden.filter("text LIKE '%anna.smith@%'").count() == 0
    assert sorted(pii_feistel.restore(hidden, b"some key").collect()) == sorted(docs.collect())


def test_values_of_a_plain_scanner_are_gone():
    """Planted values by formats written here, in sentences, against what is left of them."""
    rng = random.Random(4)
    names = pii_feistel.Pseudonyms(b"k")

    def card():
        body = [4, *[rng.randrange(10) for _ in range(14)]]
        total = sum(d if i % 2 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(body))
        digits = "".join(map(str, [*body, -total % 10]))
        return " ".join(digits[i : i + 4] for i in range(0, 16, 4))

    kinds = [lambda: f"user{rng.randrange(999)}.x@mail{rng.randrange(9)}.example.org", lambda: ".".join(str(rng.randrange(1, 255)) for _ in range(4)), card, lambda: f"{rng.randrange(100, 665)}-{rng.randrange(10, 99)}-{rng.randrange(1000, 9999)}", lambda: f"(0{rng.randrange(10, 99)}) 555-{rng.randrange(1000, 9999)}", lambda: f"{rng.randrange(1950, 2020)}-{rng.randrange(1, 13):02d}-{rng.randrange(1, 29):02d}"]
    for _ in range(400):
        values = [rng.choice(kinds)() for _ in range(rng.randrange(1, 5))]
        text = "He wrote " + " and then ".join(values) + ". End."
        new, found = pii_feistel.replace_all(text, names)
        assert len(found) == len(values) and not [v for v in values if re.search(rf"(?<![\w.]){re.escape(v)}(?![\w])", new)], text


@pytest.mark.parametrize(
    "text,old",
    [
        ("4111 1111 1111 1111 123", "4111 1111 1111 1111"), ("4111111111111111 99", "4111111111111111"), ("3 4111111111111111", "4111111111111111"),
        ("12 34 56 78 90 12 4111 1111 1111 1111 7", "4111 1111 1111 1111"), ("XX12 4111 1111 1111 1111", "4111 1111 1111 1111"), ("3782 822463 10005 44", "3782 822463 10005"),
        ("BE68539007547034 EUR", "BE68539007547034"), ("BE68 5390 0754 7034 EUROS", "BE68 5390 0754 7034"), ("AB12 BE68 5390 0754 7034", "BE68 5390 0754 7034"),
        ("555-123-4567", "555-123-4567"), ("a\n555-123-4567", "555-123-4567"), ("tel:555-123-4567", "555-123-4567"), ("+15551234567", "+15551234567"),
        ("+33 1 23 45 67 89", " 1 23 45 67 89"), ("+49 30 1234567", " 30 1234567"), ("+44 (0)20 7946 0958.", " (0)20 7946 0958"),
        ("+49 30 1234567 4111 1111 1111 1111", "4111 1111 1111 1111"), ("+33 1 23 45 67 89 555-123-4567", "555-123-4567"),
    ],
)
def test_values_beside_other_numbers_are_found(text, old):
    for key in range(40):
        names, back = (pii_feistel.Pseudonyms(b"%d" % key, b) for b in (False, True))
        new, found = pii_feistel.replace_all(text, names)
        k = text.index(old)
        assert any(a <= k + old.startswith(" ") and k + len(old) <= b for _, a, b in found) and new[k : k + len(old)] != old
        assert len(new) == len(text) and pii_feistel.restore_all(new, found, back) == text


@pytest.mark.parametrize("value", ["иван@example.com", "김철수@example.co.kr", "ÉLISE.müller@exämple.fr", "山田@例え.jp", "a@b.xn--p1ai", "2001:db8::8a2e:370:7334", "FE80:0:0:0:202:B3FF:FE1E:8329", "x.1@ünï.de"])
def test_values_in_any_script_are_replaced(value):
    for key in range(20):
        names, back = (pii_feistel.Pseudonyms(b"%d" % key, b) for b in (False, True))
        text = f"see {value}, please"
        new, found = pii_feistel.replace_all(text, names)
        assert [k for k, _, _ in found] == ["email" if "@" in value else "ipv6"]
        old, made = value.split("@")[0], new[4:].split(",")[0].split("@")[0]
        assert made != old and len(made) == len(old) and [c.isalnum() for c in made] == [c.isalnum() for c in old]
        assert pii_feistel.restore_all(new, found, back) == text


def test_no_value_is_reported_unchanged(spark, sf):
    names = pii_feistel.Pseudonyms(b"k")
    for text in ("12:30:45 and 1:2:3", "std::vector a::b", "+.%@example.com"):
        assert pii_feistel.replace_all(text, names) == (text, [])
    scanners = [r"[\w.+-]+@[\w-]+\.[\w.-]+", r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?![\d.])", r"(?<!\d)\d{3}-\d{2}-\d{4}(?!\d)", r"(?<![\d -])(?:\d{4}[ -]){3}\d{4}(?![\d-])", r"\b[A-Z]{2}\d{2}(?: ?\w{4}){3,7}\b"]
    seen = 0
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        new, found = pii_feistel.replace_all(r.text, names)
        for k, a, b in found:
            seen += 1
            assert new[a:b] not in r.text or k == "day_date"
        old = {m for p in scanners[:3] for m in re.findall(p, r.text)}
        assert not [m for m in old if m in new and names.value("email" if "@" in m else "ip" if m.count(".") == 3 else "ssn", m)]
    assert seen > 5


def test_numbers_that_do_not_validate_stay():
    names = pii_feistel.Pseudonyms(b"k")
    for text in ("1 2 3 4 5 6 7 8 9 10 11 12 13 14", "BE68539007547035 EUR", "1,234 567 8901 units", "4111 1111 1111 1112 123"):
        assert pii_feistel.replace_all(text, names) == (text, [])


@pytest.mark.parametrize("n", [2, 3, 10, 97, 1000])
def test_number_permutation(n):
    names, back = pii_feistel.Pseudonyms(b"x"), pii_feistel.Pseudonyms(b"x", True)
    image = [names.permute(x, n, "t") for x in range(n)]
    assert sorted(image) == list(range(n)) and [back.permute(y, n, "t") for y in image] == list(range(n))


# -- media ------------------------------------------------------------------------------------


def test_media_roundtrip(spark, edge, empty):
    for r in media_ts.media_roundtrip(edge).collect():
        raw = next((t or "").encode() for i, t, *_ in EDGE if i == r.doc_id)
        payload = raw.ljust(max(576, -(-len(raw) // 576) * 576), b"\xff")
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert r.continuity_errors == 0 and r.pts == sorted(r.pts) and set(r.random_access_pts) <= set(r.pts) and r.media_bytes % 188 == 0
    assert media_ts.media_roundtrip(empty).count() == 0


def test_media_counts_lost_packets_and_checks_tables():
    media = bytearray(media_ts.mux(bytes(range(256)) * 90))
    assert media_ts.demux(bytes(media))[0].continuity_errors == 0
    del media[188 * 6 : 188 * 7]
    cut = media_ts.demux(bytes(media))[0]
    assert (cut.continuity_errors, cut.damaged) == (1, 1)
    with pytest.raises(ValueError):
        media_ts.demux(b"x" * 188)


def packets(media):
    return [media[k : k + 188] for k in range(0, len(media), 188)]


def section_packets(pid, table_id, body):
    section = bytes([table_id, 0xB0 | (len(body) + 9) >> 8, (len(body) + 9) & 255, 0, 1, 0xC1, 0, 0]) + body
    data, out = b"\0" + section + media_ts._section_crc(section + b"").to_bytes(4, "big"), []
    while data:
        out.append((bytes([0x47, (0 if out else 0x40) | pid >> 8, pid & 255, 0x10 | len(out) & 15]) + data[:184]).ljust(188, b"\xff"))
        data = data[184:]
    return b"".join(out)


def test_media_of_other_muxers():
    payload = bytes(range(256)) * 90
    media = media_ts.mux(payload)
    assert media_ts.demux(media)[0].clock == media_ts.demux(media)[0].pts[:: media_ts.RANDOM_ACCESS_EVERY]
    twice = media_ts.demux(b"".join(p + p if k % 5 == 0 else p for k, p in enumerate(packets(media))))[0]
    assert (twice.data, twice.continuity_errors) == (payload, 0) and twice.repeated > 0
    pid = lambda p: (p[1] & 31) << 8 | p[2]
    pat = next(p for p in packets(media) if pid(p) == 0)
    stream = b"".join(p for p in packets(media) if pid(p) == media_ts.ES_PID)
    long_table = section_packets(media_ts.PMT_PID, 2, bytes([0xE1, 0, 0xF1, 0x2C]) + bytes(300) + bytes([6, 0xE1, 0, 0xF0, 0]))
    assert len(long_table) == 2 * 188 and media_ts.demux(pat + long_table + stream)[0].data == payload
    assert media_ts.demux(section_packets(0, 0, b"") + stream) == []
    broken = bytearray(media)
    at = next(k for k, p in enumerate(packets(media)) if pid(p) == media_ts.ES_PID and p[1] & 0x40 and k > 30)
    broken[188 * (at + 1) - packets(media)[at][::-1].index(b"\0\0\1"[::-1]) - 3] = 9
    assert media_ts.demux(bytes(broken))[0].damaged == 1


def test_bytes_that_are_no_stream_give_an_error_row(spark):
    good = media_ts.mux(b"x" * 576)
    rows = spark.createDataFrame([(1, 1, b"x"), (2, 1, bytearray(188)), (3, 1, None), (4, 1, bytearray(good)), (5, 1, bytearray(good[376:]))], "doc_id long, n_bytes long, media binary")
    got = {r.doc_id: r for r in media_ts.media_features(rows).collect()}
    assert [got[k].error for k in range(1, 6)] == ["not whole packets", "lost synchronisation", "no media", None, "no program"]
    assert got[4].payload_bytes == 576 and got[5].payload_sha256 is None and got[1].media_bytes == 1


# -- licences ----------------------------------------------------------------------------------


def test_license_inheritance(spark):
    files = [(1, "r/LICENSE", "Released under the MIT License."), (2, "r/a/x.txt", "plain words"), (3, "r/a/b/LICENSE", "This work is licensed under the GNU General Public License, version 3."), (4, "r/a/b/c/y.txt", "more plain words"), (5, "r/a/b/z.txt", "some prose here\nLicensed under the Apache License, Version 2.0."), (6, "q/w.txt", "nothing"), (7, None, "nothing"), (8, "r/n.txt", None), (9, "top.txt", "Licensed under CC BY-NC 4.0. and the rest of it is prose about other things")]
    got = {r.doc_id: r for r in license_scan.scan_licenses(spark.createDataFrame(files, "doc_id long, path string, text string")).collect()}
    assert {i: (r.license, r.origin, r.license_dir) for i, r in got.items() if i != 9} == {
        1: ("MIT", "own", None), 2: ("MIT", "inherited", "r"), 3: ("GPL-3.0", "own", None), 4: ("GPL-3.0", "inherited", "r/a/b"),
        5: ("Apache-2.0", "own", None), 6: (None, "none", None), 7: (None, "none", None), 8: ("MIT", "inherited", "r"),
    }
    assert license_scan.scan_licenses(spark.createDataFrame([], "doc_id long, path string, text string")).count() == 0


def test_full_licence_texts_headers_and_notices_in_long_lines(spark):
    from draftmetrics.llm.license_texts import FULL_TEXTS

    prose = "it was a long day and nobody in the house knew what to say about the weather " * 3
    files = [(i, f"{name}/LICENSE", text) for i, (name, text) in enumerate(sorted(FULL_TEXTS.items()))]
    files += [(10 + i, f"{name}/a/b.txt", "plain words") for i, (name, _) in enumerate(sorted(FULL_TEXTS.items()))]
    files += [(20, "x/y.txt", "Licensed under CC BY-NC 4.0. and the rest of it is prose about other things"), (21, "x/z.txt", f"{prose} Released under the MIT License. {prose}")]
    files += [(22, "x/h.py", f"{prose}\n# Licensed under the Apache License, Version 2.0 (the \"License\");\n# you may not use this file except in\n# compliance with the License.\n{prose}"), (23, "x/r.txt", "All rights reserved."), (24, "y/p.txt", prose)]
    got = {r.doc_id: r for r in license_scan.scan_licenses(spark.createDataFrame(files, "doc_id long, path string, text string")).collect()}
    for i, name in enumerate(sorted(FULL_TEXTS)):
        assert (got[i].license, got[i].origin) == (name, "own") and (got[10 + i].license, got[10 + i].origin) == (name, "inherited")
    assert [got[i].license for i in range(20, 25)] == ["CC-BY-NC-4.0", "MIT", "Apache-2.0", "Proprietary", None]


NAMES = {"Apache-2.0": "Apache-2.0", "Artistic": "Artistic-1.0", "BSD": "BSD-3-Clause", "CC0-1.0": "CC0-1.0", "GFDL-1.2": "GFDL-1.2", "GFDL-1.3": "GFDL-1.3", "GPL-1": "GPL-1.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2": "LGPL-2.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-1.1": "MPL-1.1", "MPL-2.0": "MPL-2.0"}
LINES = {
    "Licensed under CC BY-NC-SA 4.0.": "CC-BY-NC-SA-4.0", "CC BY-ND 4.0": "CC-BY-ND-4.0", "GNU Lesser General Public License, version 3": "LGPL-3.0", "BSD 2-Clause": "BSD-2-Clause",
    "// SPDX-License-Identifier: Apache-2.0": "Apache-2.0", "SPDX-License-Identifier: GPL-2.0-or-later": "GPL-2.0", "Licensed under CC BY 4.0.": "CC-BY-4.0", "All rights reserved.": "Proprietary",
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.": "ISC",
    "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License": "GPL-2.0",
}


def test_each_licence_has_its_own_name_or_none(spark, sf):
    """Whole texts of this machine's licences as files, and lines of neighbours; nothing gets another's name."""
    import pathlib

    there = {n: p.read_text() for n in NAMES if (p := pathlib.Path("/usr/share/common-licenses", n)).exists()}
    bsd2 = there.get("BSD", "").split("3. Neither")[0]
    files = [(k, f"{n}/LICENSE", text) for k, (n, text) in enumerate(there.items())] + [(100 + k, f"{n}/x/y.txt", "plain words") for k, n in enumerate(there)]
    files += [(200 + k, f"l{k}.txt", f"some prose\n{line}\nmore prose here") for k, line in enumerate(LINES)] + [(300, "bsd2/LICENSE", bsd2)]
    docs = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("doc_id + 1000 AS doc_id", "'d/' || doc_id AS path", "text")
    found = license_scan.scan_licenses(spark.createDataFrame(files, "doc_id long, path string, text string").unionByName(docs)).filter("doc_id < 1000").collect()
    got = {r.doc_id: r for r in found}
    wrong = {n: (got[k].license, got[100 + k].license) for k, n in enumerate(there) if got[k].license not in (NAMES[n], None) or got[100 + k].license not in (NAMES[n], None)}
    assert not wrong
    assert sum(got[k].license == NAMES[n] and got[100 + k].license == NAMES[n] for k, n in enumerate(there)) >= len(there) - 2
    assert {line: got[200 + k].license for k, line in enumerate(LINES)} == LINES
    assert not bsd2 or got[300].license == "BSD-2-Clause"


def test_cosines_against_plain_vectors_without_a_bound():
    import math

    rng = random.Random(6)
    pool = license_scan.vocabulary(license_scan.TEMPLATES) + [f"w{k}" for k in range(60)]
    parts = [t for many in license_scan.TEMPLATES.values() for t in many]
    texts = []
    for _ in range(60):
        words = license_scan.terms(rng.choice(parts))
        words = words[: rng.randint(1, len(words))] + rng.choices(pool, k=rng.choice([0, 1, 3, 20]))
        rng.shuffle(words)
        texts.append(" ".join(words))
    n = Counter(w for t in texts for w in set(license_scan.terms(t)))
    matcher = license_scan.Matcher(license_scan.TEMPLATES, {**n, "": len(texts)}, {}, {})  # without the words that tell licences apart
    known = set(license_scan.vocabulary(license_scan.TEMPLATES))
    idf = lambda w: math.log((1 + len(texts)) / (1 + (n[w] if w in known else 0))) + 1

    def cosine(a, b):
        x, y = ({w: c * idf(w) for w, c in Counter(k).items()} for k in (a, b))
        return sum(v * y.get(w, 0) for w, v in x.items()) / math.sqrt(sum(v * v for v in x.values()) * sum(v * v for v in y.values()))

    hits = 0
    for text in texts:
        words = license_scan.terms(text)
        whole = {name: max(cosine(words, license_scan.terms(t)) for t in many) for name, many in license_scan.TEMPLATES.items()}
        passed = {k: v for k, v in whole.items() if v >= 0.6}
        special = {k: v for k, v in passed.items() if k != license_scan.GENERAL} or passed
        name, value = matcher.best(words, 0.6)
        hits += bool(passed)
        assert (name is None) == (not passed) and (not passed or (abs(value - max(special.values())) < 1e-9 and abs(special[name] - value) < 1e-9))
        spans = {k: max((cosine(words[i : i + m], license_scan.terms(t)) for t in many if (m := len(license_scan.terms(t))) < len(words) for i in range(len(words) - m + 1)), default=0) for k, many in license_scan.TEMPLATES.items()} if len(words) < 200 else {}
        if spans:
            found = {k: v for k, v in spans.items() if v >= 0.8}
            special = {k: v for k, v in found.items() if k != license_scan.GENERAL} or found
            name, value = matcher.best_span(words, 0.8)
            assert (name is None) == (not found) and (not found or abs(value - max(special.values())) < 1e-9)
    assert hits > 20


def test_license_edge_rows(spark):
    long = "plain prose words " * 60_000 + "Released under the MIT License."
    files = [(1, "a/x.txt", long), (2, "a/x.txt", long), (3, "a/b/LICENSE", "Released under the MIT License."), (4, "a/b/COPYING", "Released under the MIT License."), (5, "a/b/c.txt", ""), (None, "/d.txt", "..."), (7, "", "")]
    df = spark.createDataFrame(files, "doc_id long, path string, text string").withColumn("DIR", F.lit("x")).withColumn("license", F.lit("y"))
    got = license_scan.scan_licenses(df).collect()
    assert len(got) == len(files)
    by = {r.doc_id: (r.license, r.origin) for r in got}
    assert by[1] == by[2] == ("MIT", "own") and by[5] == ("MIT", "inherited") and by[None] == (None, "none")


def test_document_frequencies_count_terms_beside_any_mark(spark):
    files = spark.createDataFrame([("(the) mit; 4.0",), ("the: x",), ("licence 'the'",), (None,)], "text string")
    assert license_scan.document_frequencies(files, ["the", "mit", "4.0"]) == {"": 4, "the": 3, "mit": 1, "4.0": 1}
