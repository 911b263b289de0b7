"""Statistical learning on feature tables: splits, weights, scaling, scores and p-values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def hash_order(seed: int, id_col: str) -> Column:
    """A reproducible shuffle order: MD5 of seed and id."""
    return F.md5(F.concat(F.lit(f"{seed}|"), F.col(id_col).cast("string")))


#: Hexadecimal digits of the hash that name a bucket (4096 buckets for each class).
BUCKET_DIGITS = 3


def ranked_in_class(df: DataFrame, id_col: str, label_col: str, seed: int, rank: str, size: str) -> DataFrame:
    """``df`` with each row's rank in its class, from 1, in hash order, and the rows of the class.

    Rows are ranked within buckets of the hash and moved on by the rows of the buckets
    before, so no task sorts a whole class.  Null labels are a class.
    """
    keyed = df.withColumn("_h", hash_order(seed, id_col)).withColumn("_b", F.substring("_h", 1, BUCKET_DIGITS))
    before = Window.partitionBy(label_col).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # a row for each bucket
    counted = keyed.groupBy(label_col, "_b").agg(F.count("*").alias("_n"))
    counted = counted.select(F.col(label_col).alias("_l"), F.col("_b").alias("_c"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"), F.sum("_n").over(Window.partitionBy(label_col)).alias(size))
    inside = Window.partitionBy(label_col, "_b").orderBy("_h", id_col)
    placed = keyed.withColumn("_r", F.row_number().over(inside)).join(counted, F.col(label_col).eqNullSafe(F.col("_l")) & (F.coalesce("_b", F.lit("")) == F.coalesce("_c", F.lit(""))))
    return placed.select(*df.columns, (F.col("_first") + F.col("_r")).alias(rank), size)


def stratified_split(df: DataFrame, id_col: str, label_col: str, seed: int = 0, test_percent: int = 20, folds: int = 0) -> DataFrame:
    """``df`` with ``split``: of each class the first ``test_percent`` in hash order (rounded half up) are the test set.

    With ``folds`` the rows are given ``fold`` by the same ranks: -1 for test rows, for training rows what ``stratified_folds`` gives them.
    """
    ranked = ranked_in_class(df, id_col, label_col, seed, "_rank", "_size")
    quota = F.floor((F.col("_size") * test_percent + 50) / 100)
    split = ranked.withColumn("split", F.when(F.col("_rank") <= quota, "test").otherwise("train"))
    if folds:
        split = split.withColumn("fold", F.when(F.col("_rank") <= quota, -1).otherwise((F.col("_rank") - quota - 1) % folds).cast("int"))
    return split.drop("_rank", "_size")


def stratified_folds(df: DataFrame, id_col: str, label_col: str, folds: int = 5, seed: int = 0) -> DataFrame:
    """``df`` with ``fold``: each class is dealt out in hash order."""
    ranked = ranked_in_class(df, id_col, label_col, seed, "_rank", "_size")
    return ranked.withColumn("fold", ((F.col("_rank") - 1) % folds).cast("int")).drop("_rank", "_size")


def balanced_weights(df: DataFrame, label_col: str) -> DataFrame:
    """``df`` with ``weight`` = rows / (classes * rows of the class)."""
    sizes = df.groupBy(label_col).agg(F.count("*").alias("_c"))
    total = sizes.agg(F.sum("_c").alias("_n"), F.count("*").alias("_k"))
    table = sizes.crossJoin(F.broadcast(total)).select(label_col, (F.col("_n") / (F.col("_k") * F.col("_c"))).alias("weight"))  # ``total`` is one row
    return df.join(table, label_col)


def standardize(df: DataFrame, columns: list[str], train: Column) -> DataFrame:
    """``z_<column>`` with mean and population deviation of the training rows; a constant column is only centred."""
    fit = df.filter(train).agg(*[F.avg(c).alias(f"_m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"_s_{c}") for c in columns])
    joined = df.crossJoin(F.broadcast(fit))  # ``fit`` is one row
    scaled = [((F.col(c) - F.col(f"_m_{c}")) / F.when(F.col(f"_s_{c}") > 0, F.col(f"_s_{c}")).otherwise(1.0)).alias(f"z_{c}") for c in columns]
    return joined.select(*df.columns, *scaled)


def scores(predictions: DataFrame, by: list[str], y: str = "y", yhat: str = "yhat") -> DataFrame:
    """Accuracy, macro F1 and the 2 x 2 confusion counts of each group (labels 0 and 1)."""
    cell = lambda a, b: F.count_if((F.col(y) == a) & (F.col(yhat) == b))
    counted = predictions.groupBy(*by).agg(cell(0, 0).alias("tn"), cell(0, 1).alias("fp"), cell(1, 0).alias("fn"), cell(1, 1).alias("tp"))
    f1 = lambda t, a, b: F.coalesce(F.try_divide(2 * F.col(t), 2 * F.col(t) + F.col(a) + F.col(b)), F.lit(0.0))
    seen0, seen1 = (F.col("tn") + F.col("fp") + F.col("fn")) > 0, (F.col("tp") + F.col("fp") + F.col("fn")) > 0
    macro = F.try_divide(F.when(seen0, f1("tn", "fp", "fn")).otherwise(0.0) + F.when(seen1, f1("tp", "fp", "fn")).otherwise(0.0), seen0.cast("int") + seen1.cast("int"))
    accuracy = F.try_divide(F.col("tn") + F.col("tp"), F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp"))
    return counted.withColumn("accuracy", accuracy).withColumn("f1_macro", macro)


def cv_summary(fold_scores: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """Mean and population deviation over folds."""
    return fold_scores.groupBy(*by).agg(*[F.avg(c).alias(f"{c}_mean") for c in columns], *[F.stddev_pop(c).alias(f"{c}_std") for c in columns])


def permutation_pvalue(null: DataFrame, observed: DataFrame, by: list[str], score: str = "score") -> DataFrame:
    """(by, n, p): (number of permuted scores at least as large + 1) / (n + 1)."""
    side = observed.select(*by, F.col(score).alias("_t"))
    return null.join(side, by).groupBy(*by).agg(F.count("*").alias("n"), ((F.count_if(F.col(score) >= F.col("_t")) + 1) / (F.count("*") + 1)).alias("p"))


def normalized_coefficients(coefs: DataFrame, by: list[str], value: str = "coef") -> DataFrame:
    """Each coefficient over the sum of absolute values of its group."""
    return coefs.withColumn("share", F.try_divide(F.col(value), F.sum(F.abs(F.col(value))).over(Window.partitionBy(*by))))
