"""Tables in the folder that driver and executors share.

Operators that need a stable, re-readable intermediate write it as Parquet under
``spark.checkpoint.dir``; a lost executor then costs a re-read, never a different result.
"""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from draftmetrics.session import shared_dir

_written: list[str] = []


def shared_path(spark: SparkSession, name: str) -> str:
    """A new name in the shared folder; what is written there goes when Python ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def written() -> set[str]:
    """Names in the shared folder that have been given out and not been dropped."""
    return set(_written)


def write_table(df: DataFrame, name: str, compression: str = "zstd") -> str:
    """Write ``df`` into the shared folder and return its path."""
    path = shared_path(df.sparkSession, name)
    df.write.option("compression", compression).parquet(path)
    return path


def table(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write ``df`` into the shared folder and read it back: cuts the lineage."""
    return df.sparkSession.read.schema(df.schema).parquet(write_table(df, name, compression))


def drop_table(spark: SparkSession, path: str) -> None:
    """Delete a table that no later plan reads."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    if path in _written:
        _written.remove(path)


class Scratch:
    """The tables of one operator's run, each of which can go as soon as no later plan reads it."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def table(self, df: DataFrame, name: str, compression: str = "lz4") -> DataFrame:
        """Write ``df`` into the shared folder and read it back: cuts the lineage."""
        self.paths[name] = write_table(df, name, compression)
        return self.spark.read.schema(df.schema).parquet(self.paths[name])

    def drop(self, *names: str, shuffles: bool = False) -> None:
        """Delete these tables, and with ``shuffles`` what the shuffles of finished plans hold."""
        for name in names:
            drop_table(self.spark, self.paths.pop(name))
        if shuffles:
            gc.collect()  # plans that Python no longer refers to ...
            self.spark.sparkContext._jvm.System.gc()  # ... let Spark's cleaner delete their shuffle files


@atexit.register
def _drop_all() -> None:
    spark = SparkSession.getActiveSession()
    for path in list(_written):
        with contextlib.suppress(Exception):
            if spark is not None:
                drop_table(spark, path)


def tidied(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` for mapInArrow; at its end the worker, which Spark keeps for later tasks, gives freed memory back to the system."""

    def then(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # another system's C library
                ctypes.CDLL(None).malloc_trim(0)

    return then


def text_slices(column: pa.Array, limit: int) -> Iterator[tuple[int, int, list]]:
    """(start, end, values) of runs of a string or binary column of at most ``limit`` bytes (one value may exceed it).

    Only one run's values are Python objects at a time.
    """
    for a, b in slices(pc.fill_null(pc.binary_length(column), 0).to_pylist(), limit):
        yield a, b, column.slice(a, b - a).to_pylist()


def slices(sizes: list[int], limit: int):
    """Consecutive index ranges whose sizes sum to at most ``limit`` (one item may exceed it)."""
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)
