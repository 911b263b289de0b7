"""Tables that readers never see half of: versions in folders of their own, and a log whose entries are names.

A version is written whole into a new folder; then an empty file whose name holds its number
and folder is created in the log, which any store does at once or not at all.  Readers take
the entry with the highest number.  No data are renamed, and a writer that dies leaves only a
folder that no entry names; ``vacuum`` removes those and old versions.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession

LOG, DATA = "_log", "data"


def _fs(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return place(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def entries(spark: SparkSession, root: str) -> list[tuple[int, str]]:
    """(number, folder) of every version that the log names, oldest first."""
    fs, place = _fs(spark, root)
    log = place(f"{root.rstrip('/')}/{LOG}")
    names = [s.getPath().getName() for s in fs.listStatus(log)] if fs.exists(log) else []
    return sorted((int(n.split("-", 1)[0]), n.split("-", 1)[1]) for n in names if n.split("-", 1)[0].isdigit())


def publish(df: DataFrame, root: str) -> int:
    """Write ``df`` as the newest version and return its number; until then readers see the one before."""
    spark, root = df.sparkSession, root.rstrip("/")
    folder = uuid.uuid4().hex
    df.write.parquet(f"{root}/{DATA}/{folder}")
    known = entries(spark, root)
    number = known[-1][0] + 1 if known else 1
    fs, place = _fs(spark, root)
    fs.create(place(f"{root}/{LOG}/{number:012d}-{folder}"), False).close()
    return number


def current(spark: SparkSession, root: str, number: int | None = None) -> DataFrame:
    """The newest version (or one by number)."""
    found = [f for n, f in entries(spark, root) if number in (None, n)]
    if not found:
        raise FileNotFoundError(f"{root} has no such version")
    return spark.read.parquet(f"{root.rstrip('/')}/{DATA}/{found[-1]}")


def vacuum(spark: SparkSession, root: str, keep: int = 2, older_than_hours: float = 24.0) -> int:
    """Delete versions but the newest ``keep``, then folders without an entry, each only if older than the hours given; returns how many."""
    root, keep = root.rstrip("/"), max(1, keep)
    fs, place = _fs(spark, root)
    limit = (time.time() - older_than_hours * 3600) * 1000
    known, gone = entries(spark, root), 0
    kept = {f for _, f in known[-keep:]}
    for number, folder in known[:-keep]:
        entry = place(f"{root}/{LOG}/{number:012d}-{folder}")
        if fs.getFileStatus(entry).getModificationTime() <= limit:
            fs.delete(entry, False)  # first the entry, so that no reader finds it without its data
        else:
            kept.add(folder)
    data = place(f"{root}/{DATA}")
    for status in fs.listStatus(data) if fs.exists(data) else []:
        if status.getPath().getName() not in kept and status.getModificationTime() <= limit:
            gone += bool(fs.delete(status.getPath(), True))
    return gone
