"""Spark sessions and shipping this package to the executors."""

from __future__ import annotations

import atexit
import contextlib
import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with the settings the library is tested with (UTC, AQE, ANSI)."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("draftmetrics")
    settings = {
        "spark.ui.enabled": "false",
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.driver.memory": "8g",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_shipped: set[str] = set()
#: Bytes of a batch of rows that goes to a Python worker (one row may exceed it).
BATCH_BYTES = 1 << 20


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once for each application; bound their batches where the session doesn't."""
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="draftmetrics-ship-")
    target = os.path.join(folder, "draftmetrics_package.zip")
    with zipfile.ZipFile(target, "w") as z:
        for path in sorted(root.rglob("*.py")):
            z.write(path, f"{root.name}/{path.relative_to(root)}")
    spark.sparkContext.addPyFile(target)
    _shipped.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Where none is set a session in one process gets a folder of its own; a cluster must name one.
    """
    sc = spark.sparkContext
    folder = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="draftmetrics-"))
        folder = sc.getCheckpointDir()
    return folder.rstrip("/")


_scratch: list[str] = []


def scratch_dir(spark: SparkSession) -> str:
    """A new folder name under the shared folder; what is written there goes when Python ends."""
    path = f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}"
    _scratch.append(path)
    return path


def scratch_table(df: DataFrame) -> DataFrame:
    """``df`` written into the shared folder and read back: computed once, and safe from lost executors."""
    path = scratch_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


class Scratch:
    """Scratch tables of one computation that go with ``drop``, and when Python ends at the latest."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def table(self, df: DataFrame) -> DataFrame:
        path = scratch_dir(self.spark)
        self.paths.append(path)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        """Delete the tables; no later plan may read them."""
        for path in self.paths:
            _delete(self.spark, path)
            _scratch.remove(path)
        self.paths = []


@atexit.register
def _drop_scratch() -> None:
    spark = SparkSession.getActiveSession()
    for path in _scratch:
        with contextlib.suppress(Exception):
            if spark is not None:
                _delete(spark, path)
