"""Incremental processing: each key is appended once, each URL fetched once within its time to live."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from draftmetrics.operators.labels import append_new


def append_stream(stream: DataFrame, key: str, target: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append rows of a stream whose key the target table lacks; a repeated batch adds nothing."""

    def add(batch: DataFrame, batch_id: int) -> None:
        spark: SparkSession = batch.sparkSession
        try:
            old = spark.read.parquet(target).select(key)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            old = batch.select(key).limit(0)  # the first batch makes the table
        fresh = batch.join(old.distinct(), key, "left_anti").dropDuplicates([key])
        fresh.write.mode("append").parquet(target)

    writer = stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def append_unique(stream: DataFrame, keys: list[str], target: str, checkpoint: str, time_col: str | None = None, ttl: str | None = None, once: bool = True) -> StreamingQuery:
    """Append rows whose keys have not been seen, by keyed state: a batch costs what it holds, not what the table holds.

    With a time column and a time to live (such as "24 hours" of event time) a key is
    forgotten after it, and may be appended anew; without, it is remembered for good.
    """
    unique = stream.dropDuplicates(keys) if ttl is None else stream.withWatermark(time_col, ttl).dropDuplicatesWithinWatermark(keys)
    writer = unique.writeStream.format("parquet").outputMode("append").option("path", target).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def fresh_urls(stream: DataFrame, time_col: str, url_col: str = "url", ttl: str = "24 hours") -> DataFrame:
    """A stream of requests without those repeated within the time to live."""
    return stream.withWatermark(time_col, ttl).dropDuplicatesWithinWatermark([url_col])


__all__ = ["append_new", "append_stream", "append_unique", "fresh_urls"]
