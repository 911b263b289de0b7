"""The subpackage's queries over the driver's tables, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from draftmetrics.llm import decontaminate, hard_negatives, huffman_store, jaccard_join, language_mixture, license_scan, media_ts, packing, pii_feistel, sale_enrichment, shard_permutation, token_counts, url_rules
from draftmetrics.session import ship_package

SHARDS = 24
#: Documents with more tokens are marked.
TOKEN_LIMIT = 512
#: Batches of the shop's days.
SALE_BATCHES, FIRST_SALE_DAY, SALE_DAYS = 12, 19_723, 152
#: Rules of the URL query: (host, path, action).
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(file: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(file)


def held_out() -> F.Column:
    """Documents that the language model never learns from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files ``source/block of 1000 ids/doc_id.txt``; a null source is ``_``."""
    docs = read(spark, sf_dir, "documents")
    path = F.concat_ws("/", F.coalesce("source", F.lit("_")), F.floor(F.col("doc_id") / 1000).cast("string"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return license_scan.scan_licenses(docs.select("doc_id", "text", F.when(F.col("doc_id").isNotNull(), path).alias("path")))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = language_mixture.train(docs.filter(~held_out()))
    found = language_mixture.identify(docs.select("doc_id", held_out().alias("held_out"), "text"), model, name="found")
    return found.select("doc_id", "held_out", "found.lang_pred", "found.score", "found.languages", "found.proportions")


def op3_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = huffman_store.store_roundtrip(read(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), end_id=0)
    return out.select("doc_id", "start", "n_tokens", "ids_crc32")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii_feistel.pseudonymise(read(spark, sf_dir, "documents").select("doc_id", "text"), pii_feistel.session_key(spark), name="found")
    return found.select("doc_id", "text", F.size("found.kinds").cast("long").alias("n_found"), F.array_join("found.kinds", ",").alias("kinds"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_permutation.shard(read(spark, sf_dir, "documents"), SHARDS).drop("row_number")


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, action string")
    return url_rules.judge_urls(read(spark, sf_dir, "pages"), rules)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), end_id=2, capacity=4096)


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(read(spark, sf_dir, "documents"), words=4, percent=85).select("doc_id", "n_shingles", "component_id")


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = media_ts.media_roundtrip(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find_contamination(docs, read(spark, sf_dir, "benchmark"), name="found")
    items = F.col("found.items")
    return found.select("doc_id", "found.n_words", "found.n_hit", F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"), "found.contaminated")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(read(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, label)


def op12_sale_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = lambda day: F.least(F.lit(SALE_BATCHES - 1), F.floor((day - FIRST_SALE_DAY) * SALE_BATCHES / SALE_DAYS))
    day = lambda c: F.datediff(F.col(c).cast("date"), F.lit("1970-01-01").cast("date"))
    late_by = F.crc32(F.col("change_id").cast("string").cast("binary")) % 4
    return sale_enrichment.enrich_sales(read(spark, sf_dir, "sales"), read(spark, sf_dir, "client_changes"), place(day("arrived_at")), place(day("valid_at") + late_by), SALE_BATCHES)


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.count_tokens(read(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))
    return counted.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = (op1_license_scan, op2_language_id, op3_token_store, op4_pii, op5_sharding, op6_url_filters, op7_packing, op8_jaccard_join, op9_media_columns, op10_decontamination, op11_hard_negatives, op12_sale_enrichment, op13_token_counts, pipeline)
    return {f.__name__: f for f in named}


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_URL_SQL = f"""
WITH u AS (SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, {_LOWER.format("regexp_extract(rest, '^([^/?#]*)', 1)")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(rh, rp, action) AS (VALUES {', '.join(f"('{h}', '{p}', '{a}')" for h, p, a in URL_RULES)}),
m AS (SELECT h.*, r.rh || r.rp AS rule, action FROM h LEFT JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
SELECT page_id, host, path, arg_max(rule, length(rule)) AS rule, coalesce(arg_max(action, length(rule)), 'allow') AS verdict
FROM m GROUP BY page_id, host, path
"""

_JACCARD_SQL = rf"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array({_LOWER.format("coalesce(text, '')")}, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) >= 4 THEN list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i+3], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g FROM w),
e AS (SELECT doc_id, unnest(g) AS x FROM s),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN s p ON p.doc_id = a JOIN s q ON q.doc_id = b WHERE 100 * k >= 85 * (len(p.g) + len(q.g) - k)),
t AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach(d, r) AS (SELECT doc_id, doc_id FROM s UNION SELECT reach.d, t.b FROM reach JOIN t ON reach.r = t.a)
SELECT s.doc_id, CAST(len(s.g) AS BIGINT) AS n_shingles, m.component_id FROM s JOIN (SELECT d, min(r) AS component_id FROM reach GROUP BY d) m ON m.d = s.doc_id
"""

_CONTAMINATION_SQL = rf"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array({_LOWER.format("coalesce(text, '')")}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM documents),
i AS (SELECT item_id, list_filter(regexp_split_to_array({_LOWER.format("text")}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM benchmark WHERE text IS NOT NULL),
q AS (SELECT DISTINCT item_id, n, unnest(list_transform(range(1, len(ws) - n + 2), lambda k: array_to_string(ws[k:k+n-1], ' '))) AS x FROM (SELECT *, least(13, len(ws)) AS n FROM i WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT n FROM q),
p AS (SELECT doc_id, n, unnest(range(1, len(ws) - n + 2)) AS k, ws FROM d, sizes WHERE len(ws) >= n),
o AS (SELECT p.doc_id, q.item_id, p.k, p.n FROM (SELECT doc_id, n, k, array_to_string(ws[k:k+n-1], ' ') AS x FROM p) p JOIN q ON p.n = q.n AND p.x = q.x),
hits AS (SELECT doc_id, count(DISTINCT w) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS w FROM o) GROUP BY doc_id),
its AS (SELECT doc_id, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS items FROM o GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(len(items), 0) AS BIGINT) AS n_items,
sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.ws) AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN its USING (doc_id)
"""

# crc32 of a decimal number in SQL: the table of its polynomial, then one step for each digit
_SALES_SQL = f"""
WITH tbl AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
changes AS (SELECT DISTINCT * FROM client_changes WHERE valid_at IS NOT NULL),
crc AS (SELECT changes.*, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(change_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295) AS crc FROM changes, tbl),
s AS (SELECT sale_id, client_id, sold_at, CAST(least({SALE_BATCHES - 1}, floor((date_diff('day', DATE '1970-01-01', CAST(arrived_at AS DATE)) - {FIRST_SALE_DAY}) * {SALE_BATCHES} / {SALE_DAYS})) AS BIGINT) AS b FROM sales),
c AS (SELECT change_id, client_id, valid_at, op, CAST(floor(100 * balance + 0.5) AS BIGINT) AS cents, CAST(least({SALE_BATCHES - 1}, floor((date_diff('day', DATE '1970-01-01', CAST(valid_at AS DATE)) + coalesce(crc, 0) % 4 - {FIRST_SALE_DAY}) * {SALE_BATCHES} / {SALE_DAYS})) AS BIGINT) AS b FROM crc),
w AS (SELECT k, (SELECT max(sold_at) FROM s WHERE b < k) AS ws, (SELECT max(valid_at) FROM c WHERE b < k) AS wc FROM range({SALE_BATCHES}) r(k)),
h AS (SELECT k, wc, CASE WHEN ws IS NOT NULL AND wc IS NOT NULL THEN least(ws, wc) END AS h FROM w),
marked AS (SELECT c.*, coalesce(valid_at < wc, false) AS late, (SELECT min(k) FROM h x WHERE x.h >= valid_at) AS passed FROM c JOIN h ON h.k = c.b),
v AS (SELECT *, greatest(b, min(CASE WHEN passed IS NOT NULL THEN greatest(b, passed) END) OVER (PARTITION BY client_id ORDER BY valid_at, change_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)) AS later,
  min(CASE WHEN passed IS NOT NULL THEN greatest(b, passed) END) OVER (PARTITION BY client_id ORDER BY valid_at, change_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) IS NULL AS stays FROM marked WHERE NOT late),
e AS (SELECT *, CASE WHEN sold_at IS NULL THEN b ELSE coalesce((SELECT min(k) FROM h WHERE k >= b AND h > sold_at), {SALE_BATCHES}) END AS e FROM s),
o AS (SELECT e.sale_id, e.e, count(v.b) AS n_held, arg_max({{'id': change_id, 'cents': cents, 'op': op}}, {{'t': valid_at, 'id': change_id}}) FILTER (WHERE valid_at <= sold_at) AS hit
  FROM e LEFT JOIN v ON v.client_id = e.client_id AND v.b <= e.e AND (stays OR later >= e.e) GROUP BY e.sale_id, e.e)
SELECT 'sale' AS rec, sale_id AS id, CAST(e AS BIGINT) AS batch, n_held, hit.id AS change_id, hit.cents AS balance_cents, hit.op AS op FROM o
UNION ALL SELECT 'late', change_id, b, NULL, NULL, NULL, NULL FROM marked WHERE late
"""

_NEGATIVES_SQL = """
WITH v AS (SELECT DISTINCT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT a.id AS anchor_id, b.id AS id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score FROM v a JOIN v b ON a.id % 100 = 0 AND a.id <> b.id AND len(a.v) = len(b.v)),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, id) AS INTEGER) AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, id) <= 10
"""


def oracle_sql() -> dict[str, str]:
    return {"op6_url_filters": _URL_SQL, "op8_jaccard_join": _JACCARD_SQL, "op10_decontamination": _CONTAMINATION_SQL, "op11_hard_negatives": _NEGATIVES_SQL, "op12_sale_enrichment": _SALES_SQL}
