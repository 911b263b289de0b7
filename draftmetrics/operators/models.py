"""Classifiers of the experiment grid, on whole tables.

Single linear models are MLlib's.  Folds, grids and permutations are fitted fit by fit in
tasks where the rows are one pack (``packs``), else together: linear models by rounds
(``linear_fits``), trees level by level (``trees``).  Both ways see all rows and give the same fits.
"""

from __future__ import annotations

from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.classification import LinearSVC, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from draftmetrics.operators import fits, linear_fits, packs
from draftmetrics.operators import trees as tree_growth
from draftmetrics.operators.experiments import balanced_weights, cv_summary, scores, standardize, stratified_folds, stratified_split
from draftmetrics.operators.fits import MODELS, Fit
from draftmetrics.session import scratch_table

#: Permuted forests that are grown at once level by level (half a MB for 400 trees).
FOREST_BLOCK = 20
#: Runs of a grid whose jobs are submitted side by side.
RUNS_AT_ONCE = 4


@dataclass(frozen=True)
class Run:
    """One experiment: a target cut into two classes, its features and its seed."""

    name: str
    target: str
    cut: int
    features: tuple[str, ...]
    seed: int = 0


# The published grid.
TEXT_FEATURES = ("avg_sentence_length", "exception_count", "avg_vocab_level", "foreign_words", "vague_terms")
PROCESS_FEATURES = ("proposers", "num_parties", "avg_seniority", "days_required", "meetings")
_TEXT_CUTS = (("necessity", 7, 0), ("consistency", 7, 42), ("effectiveness", 6, 0), ("procedure", 3, 0), ("influence", 6, 0), ("readability", 7, 0))
_PROCESS_CUTS = (("necessity", 7), ("consistency", 7), ("effectiveness", 7), ("procedure", 3), ("influence", 6), ("readability", 7))


def ablations(features: tuple[str, ...], target: str, cut: int, only: tuple[str, ...] = ()) -> list[Run]:
    """Every feature left out once, then the features named on their own."""
    out = [Run(f"without {f}", target, cut, tuple(x for x in features if x != f)) for f in features]
    return out + [Run(f"only {f}", target, cut, (f,)) for f in only]


GRID = (
    [Run(f"H1-{i}", f"score_{t}", c, TEXT_FEATURES, s) for i, (t, c, s) in enumerate(_TEXT_CUTS, 1)]
    + ablations(TEXT_FEATURES, "score_readability", 7, ("avg_sentence_length",))
    + [Run(f"H2-{i}", f"score_{t}", c, PROCESS_FEATURES) for i, (t, c) in enumerate(_PROCESS_CUTS, 1)]
)


def prepared(df: DataFrame, features: list[str], label: str = "y") -> DataFrame:
    """Rows with standardised features as a vector and balanced weights (fitted on training rows only)."""
    scaled = standardize(df, features, F.col("split") == "train")
    train = balanced_weights(scaled.filter("split = 'train'"), label)
    both = train.unionByName(scaled.filter("split = 'test'").withColumn("weight", F.lit(1.0)))
    return VectorAssembler(inputCols=[f"z_{c}" for c in features], outputCol="x").transform(both.withColumn("label", F.col(label).cast("double")))


def _strength(train: DataFrame, c: float = 1.0) -> float:
    return 1.0 / (c * train.agg(F.sum("weight")).first()[0])


def logistic(train: DataFrame, c: float = 1.0):
    return LogisticRegression(featuresCol="x", labelCol="label", weightCol="weight", regParam=_strength(train, c), elasticNetParam=0.0, standardization=False, maxIter=1000, tol=1e-8).fit(train)


def linear_svc(train: DataFrame, c: float = 1.0, max_iter: int = 100):
    return LinearSVC(featuresCol="x", labelCol="label", weightCol="weight", regParam=_strength(train, c), standardization=False, maxIter=max_iter).fit(train)


def svc_and_margins(train: DataFrame, features: list[str], id_col: str, folds: int = 5, seed: int = 0) -> tuple[Fit, DataFrame]:
    """A support vector machine of all training rows, and (margin, y): each row's margin of one that was fitted on the other folds."""
    dealt = scratch_table(stratified_folds(train.select(id_col, "y", *features), id_col, "y", folds, seed))
    *made, whole = packs.linear(dealt, features, id_col, [(fits.SVC, k) for k in [*range(folds), -1]])
    shared = train.sparkSession.sparkContext.broadcast(made)

    @F.pandas_udf("double")
    def margin(fold: pd.Series, *cols: pd.Series) -> pd.Series:
        x = np.column_stack([c.to_numpy(float) for c in cols])
        every = np.stack([f.margin(x) for f in shared.value], axis=1)
        return pd.Series(every[np.arange(len(x)), fold.to_numpy()])

    return whole, dealt.select(margin("fold", *features).alias("margin"), F.col("y").cast("int").alias("y"))


def margin_of(fit: Fit, features: list[str]) -> Column:
    """``Fit.margin`` of a linear model as a column."""
    terms = [(F.col(c) - float(m)) / float(s) * float(w) for c, m, s, w in zip(features, fit.mean, fit.scale, fit.beta)]
    return reduce(lambda a, b: a + b, terms, F.lit(float(fit.beta[-1])))


# -- scores in workers -----------------------------------------------------------------


def bounded(df: DataFrame, id_col: str, limit: int) -> DataFrame:
    """All rows, or the first ``limit`` in hash order where there are more; no query reads its rows by it."""
    return df.orderBy(F.xxhash64(id_col)).limit(limit) if df.count() > limit else df


def confusion(rows: DataFrame, features: list[str], jobs: list[tuple[dict, int, Fit]], part_col: str) -> DataFrame:
    """The jobs' columns and tn, fp, fn, tp: each (columns, part, fit) scores all rows of its part."""
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast([(part, fit) for _, part, fit in jobs])

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cells = np.zeros((len(jobs), 4), np.int64)
        for frame in frames:
            x, y, part = frame.iloc[:, :-2].to_numpy(float), frame.iloc[:, -2].to_numpy(), frame.iloc[:, -1].to_numpy()
            for k, (wanted, fit) in enumerate(shared.value):
                mine = part == wanted
                if mine.any():
                    cells[k] += np.bincount(2 * y[mine] + fit.predict(x[mine]), minlength=4)
        yield pd.DataFrame({"job": range(len(jobs)), "tn": cells[:, 0], "fp": cells[:, 1], "fn": cells[:, 2], "tp": cells[:, 3]})

    picked = rows.select(*[F.col(c).cast("double").alias(f"_x{k}") for k, c in enumerate(features)], F.col("y").cast("int").alias("_y"), F.col(part_col).cast("int").alias("_p"))
    summed = picked.mapInPandas(count, "job int, tn long, fp long, fn long, tp long").groupBy("job").agg(*[F.sum(c).alias(c) for c in ("tn", "fp", "fn", "tp")])
    names = spark.createDataFrame(pd.DataFrame([{"job": k} | columns for k, (columns, _, _) in enumerate(jobs)]))
    return names.join(summed, "job").drop("job")  # a row for each job


@dataclass
class TreesModel:
    """Fitted trees and normalised importances."""

    fit: Fit
    importances: list[float]

    def transform(self, df: DataFrame, columns: list[str]) -> DataFrame:
        """``df`` with ``probability_1`` and ``prediction``."""
        shared = df.sparkSession.sparkContext.broadcast(self.fit)

        @F.pandas_udf("double")
        def share(*cols: pd.Series) -> pd.Series:
            return pd.Series(shared.value.probability(np.column_stack([c.to_numpy(float) for c in cols])))

        out = df.withColumn("probability_1", share(*[F.col(c) for c in columns]))
        return out.withColumn("prediction", (F.col("probability_1") > 0.5).cast("double"))


def grown(train: DataFrame, columns: list[str], id_col: str, kind: str = fits.FOREST, trees: int = 400, depth: int = 5, seed: int = 0) -> TreesModel:
    """A random forest (bootstrap samples, classes balanced within each) or extremely randomised trees, on all rows of ``train``."""
    whole = tree_growth.grow_groves(train.withColumn("fold", F.lit(0)), columns, id_col, [(kind, -1)], trees, depth, seed)[0]
    return TreesModel(whole, fits.importances(whole.gains).tolist())


def random_forest(train: DataFrame, columns: list[str], id_col: str, trees: int = 400, depth: int = 5, seed: int = 0) -> TreesModel:
    return grown(train, columns, id_col, fits.FOREST, trees, depth, seed)


def extra_trees(train: DataFrame, columns: list[str], id_col: str, trees: int = 400, depth: int = 5, seed: int = 0) -> TreesModel:
    return grown(train, columns, id_col, fits.EXTRA_TREES, trees, depth, seed)


# -- evaluation -----------------------------------------------------------------------------


def predictions(df: DataFrame, features: list[str], id_col: str, model: str = "logistic", seed: int = 0, **options) -> DataFrame:
    """(model, id, split, y, yhat, probability_1) of one fit; ``df`` has y and split.

    A support vector machine's probabilities are Platt's sigmoid of its margins, fitted on cross-fitted margins of the training rows.
    """
    rows = scratch_table(prepared(scratch_table(df), features))
    train = rows.filter("split = 'train'")
    columns = [f"z_{c}" for c in features]
    if model == fits.LOGISTIC:
        out = logistic(train).transform(rows).withColumn("probability_1", vector_to_array("probability")[1])
    elif model == fits.SVC:
        whole, margins = svc_and_margins(train, columns, id_col, seed=seed)
        a, b = linear_fits.sigmoid_of_margins(scratch_table(margins), "margin", "y")
        if options:  # MLlib's search, whose steps are bounded
            fitted = linear_svc(train, **options).transform(rows)
            margin = vector_to_array("rawPrediction")[1]
        else:
            margin = margin_of(whole, columns)
            fitted = rows.withColumn("prediction", (margin > 0).cast("double"))
        out = fitted.withColumn("probability_1", 1 / (1 + F.exp(margin * a + b)))
    elif model in (fits.FOREST, fits.EXTRA_TREES):
        out = grown(train, columns, id_col, model, seed=seed, **options).transform(rows, columns)
    else:
        raise ValueError(model)
    return out.select(F.lit(model).alias("model"), F.col(id_col), "split", F.col("y").cast("int").alias("y"), F.col("prediction").cast("int").alias("yhat"), "probability_1")


def fold_confusion(df: DataFrame, features: list[str], id_col: str, models: tuple[str, ...] = MODELS, folds: int = 5, seed: int = 0, trees: int = 400, depth: int = 5) -> DataFrame:
    """(model, fold, tn, fp, fn, tp): ``df`` has y and split; fold -1 is the test rows after a fit on all training rows.

    Every fold of the training rows is scored, as a whole, by a fit on the other folds; a fit
    standardises its columns by its own rows.
    """
    rows = _with_folds(df, id_col, folds, seed)
    jobs = [(m, k) for m in models for k in range(-1, folds)]
    if packs.fits_one_task(rows, features):
        units = [packs.Unit(m, tuple(range(len(features))), k) for m, k in jobs]
        return _cells_table(df.sparkSession, [{"model": m, "fold": k} for m, k in jobs], packs.confusion(rows, features, id_col, units, trees, depth, seed))
    made = fit_jobs(rows.filter("fold >= 0"), features, id_col, jobs, trees, depth, seed)
    return confusion(rows, features, [({"model": m, "fold": k}, k, f) for (m, k), f in zip(jobs, made)], "fold")


def _with_folds(df: DataFrame, id_col: str, folds: int, seed: int) -> DataFrame:
    """``df`` (y, split; without split its rows are split) with ``fold``, -1 for test rows; computed once."""
    if "split" not in df.columns:
        return scratch_table(stratified_split(df, id_col, "y", seed, folds=folds))
    df = scratch_table(df)  # its plan would run for training and test rows
    train = stratified_folds(df.filter("split = 'train'"), id_col, "y", folds, seed)
    return scratch_table(train.unionByName(df.filter("split = 'test'").withColumn("fold", F.lit(-1))))


def _cells_table(spark: SparkSession, names: list[dict], cells: list[tuple[int, int, int, int]]) -> DataFrame:
    """The columns of ``names`` and tn, fp, fn, tp."""
    return spark.createDataFrame(pd.DataFrame([n | dict(zip(("tn", "fp", "fn", "tp"), map(int, c))) for n, c in zip(names, cells)]))


def fit_jobs(rows: DataFrame, features: list[str], id_col: str, jobs: list[tuple[str, int]], trees: int = 400, depth: int = 5, seed: int = 0) -> list[Fit]:
    """The fits of (model, fold left out or -1) over all rows: linear ones together, trees together."""
    linear = [k for k, (m, _) in enumerate(jobs) if m in (fits.LOGISTIC, fits.SVC)]
    rest = [k for k in range(len(jobs)) if k not in linear]
    made: dict[int, Fit] = {}
    if linear:
        made |= dict(zip(linear, linear_fits.fit_all(rows, features, [linear_fits.Job(*jobs[k]) for k in linear])))
    if rest:
        made |= dict(zip(rest, tree_growth.grow_groves(rows, features, id_col, [jobs[k] for k in rest], trees, depth, seed)))
    return [made[k] for k in range(len(jobs))]


def cross_validate(df: DataFrame, features: list[str], id_col: str, models: tuple[str, ...] = MODELS, folds: int = 5, seed: int = 0, **options) -> DataFrame:
    """(model, fold, tn, fp, fn, tp, accuracy, f1_macro) of every fold and of the test rows (fold -1)."""
    return scores_of_cells(fold_confusion(df, features, id_col, models, folds, seed, **options))


def evaluate(df: DataFrame, runs: list[Run], id_col: str, models: tuple[str, ...] = MODELS, **options) -> DataFrame:
    """One row for each run and model: mean and deviation of the folds' scores, scores and confusion counts of the test rows.

    ``df`` has the targets and all features.  Runs over the same rows (target, cut, seed, and
    features that have gaps) are split once and fitted side by side.
    """
    spark, used = df.sparkSession, sorted({f for r in runs for f in r.features})
    gaps = df.agg(*[F.count_if(F.col(f).isNull() | F.isnan(F.col(f).cast("double"))).alias(f) for f in used]).first()
    views: dict[tuple, list[Run]] = {}
    for r in runs:
        views.setdefault((r.target, r.cut, r.seed, tuple(sorted({f for f in r.features if gaps[f]}))), []).append(r)

    order, folds = list(views), options.get("folds", 5)
    features = [list(dict.fromkeys(f for r in views[view] for f in r.features)) for view in order]

    def dealt(i: int) -> DataFrame:
        target, cut, seed, gappy = order[i]
        kept = df.filter(F.col(target).isNotNull()).withColumn("y", (F.col(target) > cut).cast("int")).na.drop(subset=list(gappy or features[i]))
        return _with_folds(kept.select(id_col, "y", *features[i]), id_col, folds, seed)

    def by_rounds(i: int) -> list[DataFrame]:
        split = rows[i].drop("fold")
        return [cross_validate(split, list(r.features), id_col, models, seed=order[i][2], **options).withColumn("run", F.lit(r.name)) for r in views[order[i]]]

    with ThreadPoolExecutor(RUNS_AT_ONCE) as pool:  # the driver only waits; the cluster works on several views' jobs
        rows = list(pool.map(dealt, range(len(order))))
        sizes = dict(reduce(DataFrame.union, [r.select(F.lit(i).alias("i")) for i, r in enumerate(rows)]).groupBy("i").count().collect())  # a row for each view
        small = [i for i in range(len(order)) if sizes.get(i, 0) <= packs.rows_of_a_pack(features[i])]
        parts = [part for some in pool.map(by_rounds, [i for i in range(len(order)) if i not in small]) for part in some]
    if small:  # the fits of all views are tasks of one job
        what = [[(r, m, k) for r in views[order[i]] for m in models for k in range(-1, folds)] for i in small]
        units = [[packs.Unit(m, tuple(features[i].index(f) for f in r.features), k) for r, m, k in some] for i, some in zip(small, what)]
        how = {k: v for k, v in options.items() if k != "folds"}
        cells = packs.confusions([(rows[i], features[i], own, order[i][2]) for i, own in zip(small, units)], id_col, **how)
        names = [{"run": r.name, "model": m, "fold": k} for some in what for r, m, k in some]
        parts.append(scores_of_cells(_cells_table(spark, names, [c for own in cells for c in own])))
    found = scratch_table(reduce(DataFrame.unionByName, parts))
    folds = cv_summary(found.filter("fold >= 0"), ["run", "model"], ["accuracy", "f1_macro"])
    whole = folds.join(found.filter("fold = -1").drop("fold"), ["run", "model"])
    return whole.select(*[c for c in whole.columns if c != "run"], "run")


def scores_of_cells(cells: DataFrame) -> DataFrame:
    """Accuracy and macro F1 beside columns tn, fp, fn and tp."""
    accuracy = F.try_divide(F.col("tn") + F.col("tp"), F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp"))
    return cells.withColumn("accuracy", accuracy).withColumn("f1_macro", macro_f1_of_cells())


def macro_f1_of_cells() -> Column:
    """Macro F1 of columns tn, fp, fn and tp over the classes that occur; 0 where none does."""
    wrong = F.col("fp") + F.col("fn")
    f1 = [F.try_divide(2 * F.col(t), 2 * F.col(t) + wrong) for t in ("tn", "tp")]
    seen = f1[0].isNotNull().cast("int") + f1[1].isNotNull().cast("int")
    return F.coalesce(F.try_divide(F.coalesce(f1[0], F.lit(0.0)) + F.coalesce(f1[1], F.lit(0.0)), seen), F.lit(0.0))


def permutation_null(df: DataFrame, features: list[str], id_col: str, models: tuple[str, ...] = MODELS, permutations: int = 1000, seed: int = 0, trees: int = 400, depth: int = 5) -> DataFrame:
    """(model, perm_id, score): macro F1 on all test rows after a fit on permuted training labels; -1 is the true labels' score.

    Every model sees the same permutations, and a forest the same samples and cuts for each of
    them.  Where the rows with their labels are one pack, tasks fit and score some of the
    permutations each; else linear models are fitted together, and forests are grown level by
    level in blocks, so that the driver holds a block's at most.  Both ways see all training rows
    and grow the same trees.
    """
    rows = scratch_table(df)
    train = scratch_table(linear_fits.with_permutations(rows.filter("split = 'train'"), id_col, permutations, seed).withColumn("fold", F.lit(0)))
    whole = train.unionByName(rows.filter("split = 'test'").withColumn("bits", F.unhex(F.lit("00" * ((permutations + 7) // 8)))).withColumn("fold", F.lit(-1)))
    if packs.fits_one_task(whole, features, permutations):
        units = [packs.Unit(m, tuple(range(len(features))), -1, k) for m in models for k in range(-1, permutations)]
        cells = packs.confusion(whole, features, id_col, units, trees, depth, seed)
        table = _cells_table(df.sparkSession, [{"model": u.kind, "perm_id": u.permutation} for u in units], cells)
        return table.select("model", F.col("perm_id").cast("long"), macro_f1_of_cells().alias("score"))
    test = rows.filter("split = 'test'").withColumn("part", F.lit(0))
    ids, parts = list(range(-1, permutations)), []

    def scored(model: str, ids: list[int], made: list[Fit]) -> None:
        cells = confusion(test, features, [({"model": model, "perm_id": k}, 0, f) for k, f in zip(ids, made)], "part")
        parts.append(scratch_table(cells.select("model", F.col("perm_id").cast("long"), macro_f1_of_cells().alias("score"))))

    linear = [m for m in models if m in (fits.LOGISTIC, fits.SVC)]
    made = linear_fits.fit_all(train, features, [linear_fits.Job(m, -1, k) for m in linear for k in ids])
    for i, m in enumerate(linear):
        scored(m, ids, made[i * len(ids) : (i + 1) * len(ids)])
    if len(linear) < len(models):
        cuts = tree_growth.bin_cuts(whole.filter("fold >= 0"), features)
        for m in [m for m in models if m not in linear]:
            for a in range(0, len(ids), FOREST_BLOCK):
                some = ids[a : a + FOREST_BLOCK]
                scored(m, some, tree_growth.grow_groves(train, features, id_col, [(m, -1, k) for k in some], trees, depth, seed, cuts))
    return reduce(DataFrame.unionByName, parts)


def coefficients(model, features: list[str], spark) -> DataFrame:
    """(feature, coef) of a linear model."""
    return spark.createDataFrame([(f, float(c)) for f, c in zip(features, model.coefficients)], "feature string, coef double")


def importances(model, features: list[str], spark) -> DataFrame:
    """(feature, importance) of a forest, largest first."""
    values = model.importances if isinstance(model, TreesModel) else model.featureImportances.toArray()
    return spark.createDataFrame([(f, float(v)) for f, v in zip(features, values)], "feature string, importance double").orderBy(F.desc("importance"), "feature")
