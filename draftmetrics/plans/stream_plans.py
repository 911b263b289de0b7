"""Queries that run as streams over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from draftmetrics.session import scratch_dir
from draftmetrics.streaming.incremental import append_unique

QUERIES, SQL = {}, {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return register


@query("SELECT user_id, event_type, min(CASE WHEN event_id % 3 = 0 THEN 0 ELSE 1 END) AS run FROM events GROUP BY user_id, event_type")
def first_seen_stream(spark: SparkSession, d: str) -> DataFrame:
    """(user_id, event_type, run): the first of two runs of a stream on one checkpoint that brings a pair; the state remembers it."""
    feed, target, checkpoint = (scratch_dir(spark) for _ in range(3))
    run = F.when(F.col("event_id") % 3 == 0, 0).otherwise(1)
    events = spark.read.parquet(f"{d}/events.parquet").select("user_id", "event_type", run.alias("run"))
    schema = "user_id long, event_type string, run int"
    for k in (0, 1):
        events.filter(F.col("run") == k).write.parquet(f"{feed}/{k}")
        stream = spark.readStream.schema(schema).parquet(f"{feed}/*")
        append_unique(stream, ["user_id", "event_type"], target, checkpoint).awaitTermination()
    return spark.read.schema(schema).parquet(target)
