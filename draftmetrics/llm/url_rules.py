"""URL filters by hashed host-suffix and path-prefix expressions.

A URL is expanded into suffixes of its host, as many labels long as some rule's host, times
prefixes of its path that have the length of some rule's path.  Expressions and rules meet in an equi-join
on the first 32 bits of their SHA-256 digests; full digests confirm a match.  The longest
rule wins (then the longer host, then a block); where no rule fits, the default verdict
of a blocklist holds: allow.

Nulls: a null URL, or one without ``://``, has an empty host and path and fits no rule.
Rules with a null host or path are ignored; a rule's host is compared in lower case, and
equal rules count as one, a block before an allow.  Repeated rows are judged each for
itself.  Very long URLs give no more expressions than others.  An empty table gives an
empty table; other columns are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rules that may be broadcast; beyond it the join is shuffled.
BROADCAST_RULES = 200_000
DEFAULT_VERDICT = "allow"


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_host_path(url: Column) -> tuple[Column, Column]:
    """Host (after the first ``://`` up to ``/ ? #``, A-Z lower-cased) and path (then up to ``? #``)."""
    found = F.coalesce(F.instr(url, "://"), F.lit(0)) > 0
    rest = F.when(found, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return ascii_lower(host), path


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row; ``rules`` has host, path and action."""
    known = rules.filter("host IS NOT NULL AND path IS NOT NULL").select(ascii_lower(F.col("host")).alias("rule_host"), F.col("path").alias("rule_path"), F.lower("action").alias("action"))
    sized = known.agg(F.count("*").alias("n"), F.array_sort(F.collect_set(F.length("rule_path"))).alias("lengths"), F.array_sort(F.collect_set(F.size(F.split("rule_host", r"\.")))).alias("labels")).first()
    digest = F.unhex(F.sha2(F.concat("rule_host", "rule_path").cast("binary"), 256))
    known = known.select(F.concat("rule_host", "rule_path").alias("rule"), "action", F.length("rule_host").alias("host_length"), digest.alias("rule_digest"))
    known = known.withColumn("short", F.substring("rule_digest", 1, 4))
    # lengths are numbers, not rules: as many as there are different ones
    lengths, n_labels = (F.array(*[F.lit(int(x)) for x in sized[k]]) if sized[k] else F.array().cast("array<int>") for k in ("lengths", "labels"))
    host, path = url_host_path(F.col(url_col).cast("string"))
    urls = pages.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.filter(n_labels, lambda n: n <= F.size(labels)), lambda n: F.array_join(F.slice(labels, F.size(labels) - n + 1, n), "."))
    prefixes = F.transform(F.filter(lengths, lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))
    expressions = F.flatten(F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: F.concat(h, p))))
    opened = urls.withColumn("expression", F.explode_outer(expressions))
    opened = opened.withColumn("digest", F.unhex(F.sha2(F.col("expression").cast("binary"), 256))).withColumn("short", F.substring("digest", 1, 4))
    side = F.broadcast(known) if sized["n"] <= BROADCAST_RULES else known
    met = opened.join(side, "short", "left")
    fits = F.when(F.col("digest") == F.col("rule_digest"), F.struct(F.length("rule").alias("length"), "host_length", (F.col("action") == "block").alias("block"), "rule", "action"))
    judged = met.groupBy("row").agg(F.first("page_id").alias("page_id"), F.first("host").alias("host"), F.first("path").alias("path"), F.max(fits).alias("best"))
    return judged.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.action", F.lit(DEFAULT_VERDICT)).alias("verdict"))
