"""Connected components by alternating large and small stars, without a driver-side graph."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from draftmetrics.llm.shared import Scratch


def components(edges: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(node, label) of every node of ``edges(u, v)``; the label is its component's smallest node.

    Each round writes its edges to the shared folder and drops those of the round before; the
    last ones are the caller's ``scratch``.  Minima are pre-aggregated before a
    shuffle, so a star's centre is no hot spot; the join back is one that adaptive
    execution can split.
    """
    scratch = scratch or Scratch(edges.sparkSession)
    base, step = f"edges-{uuid.uuid4().hex}", 0
    now = scratch.table(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), f"{base}-0")
    mark = None
    while True:
        # large star: neighbours larger than u are tied to u's smallest neighbour (or u)
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        # small star: u and its smaller neighbours are tied to the smallest of them
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        tied = large.join(small, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v")))
        step += 1
        now = scratch.table(tied.filter("u <> v").distinct(), f"{base}-{step}")
        del both, least, large, small, tied
        scratch.drop(f"{base}-{step - 1}")
        new = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if new == mark:
            break
        mark = new
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).union(now.select(F.col("v").alias("node"), F.col("v").alias("label"))).distinct()
