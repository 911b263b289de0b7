"""Sharding by a Feistel permutation with cycle walking over global row numbers.

Row numbers come from the rows' content, not from the layout of the input: rows are
dealt into buckets by hash and ordered within a bucket by (doc_id, checksum, size, text
hash); a bucket's offset is the sum of the buckets before it.  Equal rows are counted
before any shuffle and unfolded at the end, so they never meet in one task.

A keyed Feistel network over pairs (l, r) of numbers below a = ceil(sqrt(n)) permutes
0 .. a*a - 1; a number that lands at or beyond n walks on until it is below n, which
makes a permutation of 0 .. n - 1.  Place p goes to shard ``p % shards``, slot
``p // shards``: shard sizes differ by one row at most and slots have no gaps.

Nulls: a null text has no bytes; null ids come first in their bucket.  Repeated rows have
places of their own.  Of a very long text only size and hashes are kept.  An empty table
gives an empty table.  Other columns are not read, whatever their names.  DataFrame
functions only.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from draftmetrics.llm.shared import table

#: Rows of a bucket on average, and buckets at most (their offsets are one small table).
BUCKET_ROWS, MAX_BUCKETS = 100_000, 1 << 16
#: Equal rows that one task unfolds at once.
UNFOLD = 10_000
ROUNDS, WALKS = 6, 4


def permuted(x: Column, n: int, key: int) -> Column:
    """The place of number ``x`` (0 <= x < n) in the keyed permutation of 0 .. n - 1."""
    a = isqrt(max(n, 1) - 1) + 1

    def once(value: Column) -> Column:
        high = ((value - F.pmod(value, F.lit(a))) / F.lit(a)).cast("long")  # exact: a divides it
        start = F.struct(high.alias("l"), F.pmod(value, F.lit(a)).cast("long").alias("r"))
        keys = F.array(*[F.lit(key * 1_000_003 + k).cast("long") for k in range(ROUNDS)])
        return F.aggregate(keys, start, lambda acc, k: F.struct(acc["r"].alias("l"), F.pmod(acc["l"] + F.pmod(F.xxhash64(acc["r"], k), F.lit(a)), F.lit(a)).cast("long").alias("r")), lambda acc: acc["l"] * F.lit(a) + acc["r"])

    # a walk leaves the a*a - n numbers outside after as many steps at most
    outside = a * a - n + 1
    return F.aggregate(F.sequence(F.lit(1), F.lit(min(outside, WALKS))), once(x), lambda acc, _: F.when(acc < n, acc).otherwise(once(acc)), lambda acc: F.when(acc < n, acc).otherwise(F.aggregate(F.sequence(F.lit(1), F.lit(outside)), acc, lambda y, _: F.when(y < n, y).otherwise(once(y)))))


def numbered(rows: DataFrame, order: list[str]) -> tuple[DataFrame, int]:
    """Every row of ``rows`` with ``row_number`` from 0 (all of ``order`` are its columns), and the number of rows."""
    rows = table(rows, "shard-rows")
    n = rows.count()
    buckets = max(1, min(MAX_BUCKETS, -(-n // BUCKET_ROWS)))
    folded = rows.groupBy(*order).agg(F.count("*").alias("copies")).withColumn("bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    folded = table(folded, "shard-folded")
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # MAX_BUCKETS rows at most
    offsets = folded.groupBy("bucket").agg(F.sum("copies").alias("total")).select("bucket", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("bucket_start"))
    inside = Window.partitionBy("bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = folded.withColumn("within", F.coalesce(F.sum("copies").over(inside), F.lit(0))).join(F.broadcast(offsets), "bucket")
    placed = placed.withColumn("first", F.col("bucket_start") + F.col("within"))
    few = placed.filter(F.col("copies") <= UNFOLD)
    many = placed.filter(F.col("copies") > UNFOLD).withColumn("part", F.explode(F.sequence(F.lit(0), F.floor((F.col("copies") - 1) / UNFOLD)))).withColumn("first", F.col("first") + F.col("part") * UNFOLD).withColumn("copies", F.least(F.lit(UNFOLD), F.col("copies") - F.col("part") * UNFOLD)).drop("part")
    unfold = lambda df: df.select(*order, F.explode(F.sequence(F.col("first"), F.col("first") + F.col("copies") - 1)).alias("row_number"))
    return unfold(few).unionByName(unfold(many.repartition("first"))), n


def shard(docs: DataFrame, shards: int, key: int = 20_240_229, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every row."""
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 8).alias("size"), F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("text_hash"))
    rows, n = numbered(rows, ["doc_id", "text_crc32", "size", "text_hash"])
    place = rows.withColumn("place", permuted(F.col("row_number"), n, key))
    return place.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.pmod("place", F.lit(shards)).cast("int").alias("shard"), ((F.col("place") - F.pmod("place", F.lit(shards))) / shards).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "row_number")
