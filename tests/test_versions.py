"""Versioned tables under readers that never stop, and keyed state with a time to live."""

import threading
from datetime import datetime, timedelta

import pytest

from draftmetrics.sources import versions
from draftmetrics.streaming.incremental import append_unique


def test_readers_never_fail_while_versions_change(spark, tmp_path):
    root = str(tmp_path / "table")
    versions.publish(spark.range(100).selectExpr("id", "0 AS v"), root)
    seen, errors, stop = set(), [], threading.Event()

    def read():
        while not stop.is_set():
            try:
                rows = versions.current(spark, root).groupBy("v").count().collect()
                assert len(rows) == 1 and rows[0]["count"] == 100
                seen.add(rows[0]["v"])
            except Exception as e:  # noqa: BLE001
                errors.append(e)

    reader = threading.Thread(target=read)
    reader.start()
    for v in range(1, 26):
        assert versions.publish(spark.range(100).coalesce(2).selectExpr("id", f"{v} AS v"), root) == v + 1
    stop.set()
    reader.join()
    assert not errors and len(seen) > 1
    assert versions.current(spark, root).first().v == 25 and versions.current(spark, root, 3).first().v == 2


def test_a_failed_write_shows_nothing_and_old_versions_go(spark, tmp_path):
    root = str(tmp_path / "table")
    with pytest.raises(FileNotFoundError):
        versions.current(spark, root)
    for v in range(4):
        versions.publish(spark.createDataFrame([(v,)], "v int"), root)
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO|by zero"):
        versions.publish(spark.range(5).selectExpr("1 / (id - 3) AS v"), root)
    assert versions.current(spark, root).first().v == 3
    assert versions.vacuum(spark, root) == 0  # too young
    assert versions.vacuum(spark, root, keep=2, older_than_hours=-1) >= 2
    assert [n for n, _ in versions.entries(spark, root)] == [3, 4] and versions.current(spark, root, 3).first().v == 2


def test_keys_are_remembered_for_their_time_to_live(spark, tmp_path):
    feed, at = str(tmp_path / "feed"), datetime(2024, 1, 1)
    schema = "k string, at timestamp, n int"

    def run(name, rows, **ttl):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(feed)
        append_unique(spark.readStream.schema(schema).parquet(feed), ["k"], str(tmp_path / f"out-{name}"), str(tmp_path / f"checkpoint-{name}"), **ttl).awaitTermination()
        return sorted((r.k, r.n) for r in spark.read.schema(schema).parquet(str(tmp_path / f"out-{name}")).collect())

    short = {"time_col": "at", "ttl": "1 hour"}
    assert run("a", [("x", at, 1), ("y", at, 1)], **short) == [("x", 1), ("y", 1)]
    assert run("a", [("x", at + timedelta(minutes=30), 2), ("z", at + timedelta(hours=5), 2)], **short) == [("x", 1), ("y", 1), ("z", 2)]
    assert run("a", [("x", at + timedelta(hours=6), 3)], **short) == [("x", 1), ("x", 3), ("y", 1), ("z", 2)]  # forgotten meanwhile
