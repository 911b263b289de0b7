"""A training-data pipeline over ``documents``, stage by stage.

Every stage takes ``(spark, docs, sf_dir)`` and works on all that its predecessor kept.
``run`` writes each stage's rows as Parquet into the shared folder and reads them again
for the next.  All stages but the last return the columns of ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from draftmetrics.llm import decontaminate, jaccard_join, language_mixture, packing, pii_feistel, queries
from draftmetrics.llm.rowmap import free_name
from draftmetrics.llm.shared import drop_table, write_table, written
from draftmetrics.session import ship_package


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can't be determined (no text or no letter) go."""
    ship_package(spark)
    model = language_mixture.train(docs.filter(~queries.held_out()))
    name = free_name(docs, "language")
    found = language_mixture.identify(docs, model, name=name)
    return found.filter(F.col(f"{name}.lang_pred") != language_mixture.UNDETERMINED).drop(name)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that n-gram Jaccard links join, the one with the smallest id stays.

    Documents without words are no group and stay; of repeated rows one stays.
    """
    ship_package(spark)
    return jaccard_join.keep_one(docs, words=4, percent=85)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which at least a twentieth lies in benchmark passages go."""
    ship_package(spark)
    name = free_name(docs, "contamination")
    found = decontaminate.find_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), name=name)
    return found.filter(~F.col(f"{name}.contaminated")).drop(name)


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data are replaced by pseudonyms of the same format."""
    ship_package(spark)
    name = free_name(docs, "pii")
    out = pii_feistel.pseudonymise(docs, pii_feistel.session_key(spark), name=name).drop(name)
    return out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))) if "n_chars" in docs.columns else out


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, in training sequences."""
    ship_package(spark)
    return packing.pack(docs, queries.tokenizer_path("word_bpe_49k.json"), end_id=2, capacity=4096)


STAGES = [("language_id", language_id), ("near_duplicates", near_duplicates), ("benchmark_decontamination", benchmark_decontamination), ("pii", pseudonyms), ("packing", pack)]

#: SQL can express neither the language model nor the tokenizer; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage.  A stage's input and its own tables go when its rows are written."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        before = written() - {last}
        last = write_table(stage(spark, docs, sf_dir), f"pipeline-{name}")
        for path in written() - before - {last}:
            drop_table(spark, path)
        docs = spark.read.parquet(last)
    return docs
