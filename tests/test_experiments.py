"""Splits, scores and models."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from draftmetrics.operators import experiments as ex
from draftmetrics.operators import fits, linear_fits
from draftmetrics.operators import models as ml
from draftmetrics.operators import trees as tree_growth


@pytest.fixture(scope="module")
def planted(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 3))
    y = (x[:, 0] + 0.3 * rng.normal(size=300) > 0.4).astype(int)
    rows = [(i, *map(float, x[i]), int(y[i])) for i in range(300)]
    return ex.stratified_split(spark.createDataFrame(rows, "id long, a double, b double, c double, y int"), "id", "y").cache()


def test_split_is_stratified_disjoint_and_stable(planted):
    counts = {(r.y, r.split): r["count"] for r in planted.groupBy("y", "split").count().collect()}
    for y in (0, 1):
        n = counts[y, "train"] + counts[y, "test"]
        assert counts[y, "test"] == (n * 20 + 50) // 100
    again = ex.stratified_split(planted.drop("split").repartition(5), "id", "y")
    assert planted.exceptAll(again.select(planted.columns)).count() == 0
    folds = ex.stratified_folds(planted, "id", "y").groupBy("y", "fold").count().groupBy("y").agg((F.max("count") - F.min("count")).alias("d")).collect()
    assert all(r.d <= 1 for r in folds)


def test_scores_of_a_class_never_predicted(spark):
    df = spark.createDataFrame([("m", 0, 0), ("m", 1, 0), ("m", 0, 0)], "m string, y int, yhat int")
    r = ex.scores(df, ["m"]).first()
    assert (r.tn, r.fn, r.tp, r.fp) == (2, 1, 0, 0) and r.f1_macro == pytest.approx(0.4) and r.accuracy == pytest.approx(2 / 3)


def test_p_value_counts_ties(spark):
    null = spark.createDataFrame([("e", 0.5), ("e", 0.6), ("e", 0.7)], "e string, score double")
    assert ex.permutation_pvalue(null, spark.createDataFrame([("e", 0.6)], "e string, score double"), ["e"]).first().p == pytest.approx(3 / 4)


def test_standardize_fits_training_rows_only(spark):
    df = spark.createDataFrame([(1, 1.0, 5.0), (2, 3.0, 5.0), (3, 100.0, 5.0)], "id long, a double, c double")
    got = {r.id: (r.z_a, r.z_c) for r in ex.standardize(df, ["a", "c"], F.col("id") < 3).collect()}
    assert got == {1: (-1.0, 0.0), 2: (1.0, 0.0), 3: (98.0, 0.0)}


def matrix(df, split="train"):
    data = df.filter(F.col("split") == split).orderBy("id").select("a", "b", "c", "y").toPandas()
    return data[["a", "b", "c"]].to_numpy(), data["y"].to_numpy()


def test_fits_in_workers_equal_mllib(planted):
    rows = ml.prepared(planted, ["a", "b", "c"])
    train = rows.filter("split = 'train'")
    model = ml.logistic(train)
    fit = fits.fit("logistic", *matrix(planted), [0])
    assert np.allclose(model.coefficients.toArray(), fit.beta[:3], atol=1e-4) and abs(model.intercept - fit.beta[3]) < 1e-4
    svc, own = ml.linear_svc(train), fits.fit("svc", *matrix(planted), [0])
    assert np.allclose(svc.coefficients.toArray(), own.beta[:3], atol=0.05)

    def objective(beta):
        x, y = matrix(planted)
        z = (x - own.mean) / own.scale
        return 0.5 * beta[:3] @ beta[:3] + (fits.balanced(y.astype(float)) * np.maximum(0, 1 - (2 * y - 1) * (z @ beta[:3] + beta[3]))).sum()

    assert objective(own.beta) < objective(np.append(svc.coefficients.toArray(), svc.intercept)) + 1e-2


def plain_tree(feature, threshold, share, row):
    k = 0
    while feature[k] >= 0:
        k = 2 * k + 1 + (row[feature[k]] > threshold[k])
    return share[k]


@pytest.mark.parametrize("kind", ["forest", "extra_trees"])
def test_trees_grown_together_equal_plain_walks_and_sums(planted, kind):
    x, y = matrix(planted)
    fit = fits.fit(kind, x, y, [3], trees=7)
    expected = [np.mean([plain_tree(fit.feature[t], fit.threshold[t], fit.share[t], row) for t in range(7)]) for row in x]
    assert np.allclose(fit.probability(x), expected)
    if kind == "extra_trees":  # every node's share and split are those of its own rows
        w = fits.balanced(y.astype(float))
        for t in range(7):
            stack = [(0, np.arange(len(y)))]
            while stack:
                k, rows = stack.pop()
                assert fit.share[t, k] == pytest.approx((w[rows] * y[rows]).sum() / w[rows].sum())
                if fit.feature[t, k] >= 0:
                    right = x[rows, fit.feature[t, k]] > fit.threshold[t, k]
                    assert 0 < right.sum() < len(rows)
                    stack += [(2 * k + 1, rows[~right]), (2 * k + 2, rows[right])]
    assert fits.importances(fit.gains).argmax() == 0


def test_best_cut_is_the_best_of_all(planted):
    x, y = matrix(planted)
    x = np.round(x[:, :1] * 4)  # few values: every cut is a threshold
    feature, threshold, share, _ = fits.grow(x, y.astype(float), np.ones((1, len(y))), 1, np.random.default_rng(0), True)

    def impurity(rows):
        p = y[rows].mean()
        return rows.sum() * 2 * p * (1 - p)

    every = {c: impurity(x[:, 0] <= c) + impurity(x[:, 0] > c) for c in (np.unique(x)[1:] + np.unique(x)[:-1]) / 2}
    assert feature[0, 0] == 0 and every[threshold[0, 0]] == pytest.approx(min(every.values()))


def test_folds_are_scored_whole_by_fits_that_have_not_seen_them(spark, planted):
    got = {(r.model, r.fold): r for r in ml.cross_validate(planted, ["a", "b", "c"], "id", trees=20).collect()}
    assert set(got) == {(m, k) for m in ml.MODELS for k in range(-1, 5)}
    folds = ex.stratified_folds(planted.filter("split = 'train'"), "id", "y")
    sizes = {r.fold: r["count"] for r in folds.groupBy("fold").count().collect()} | {-1: planted.filter("split = 'test'").count()}
    assert all(r.tn + r.fp + r.fn + r.tp == sizes[k] for (_, k), r in got.items())
    data = folds.orderBy("id").toPandas()
    for k in range(5):
        held, seen = data[data.fold == k], data[data.fold != k]
        fit = fits.fit("logistic", seen[["a", "b", "c"]].to_numpy(), seen.y.to_numpy(), [0])
        assert np.allclose(fit.mean, seen[["a", "b", "c"]].mean()) and got["logistic", k].accuracy == pytest.approx((fit.predict(held[["a", "b", "c"]].to_numpy()) == held.y).mean())
    # rows of a fold, however far off, change no fit that is scored on them
    far = planted.withColumn("a", F.when(F.col("id") == int(data[data.fold == 2].id.iloc[0]), 1e9).otherwise(F.col("a")))
    moved = {(r.model, r.fold): r for r in ml.cross_validate(far, ["a", "b", "c"], "id", models=("logistic",)).collect()}
    assert abs(moved["logistic", 2].accuracy - got["logistic", 2].accuracy) <= 1 / sizes[2] + 1e-9


def test_grid_rows(spark, planted):
    runs = [ml.Run("one", "y", 0, ("a", "b"), 1), ml.Run("two", "y", 0, ("c",))]
    got = {(r.run, r.model): r for r in ml.evaluate(planted.drop("split"), runs, "id", trees=10).collect()}
    assert len(got) == 8 and got["one", "forest"].f1_macro > got["two", "forest"].f1_macro and got["one", "svc"].accuracy_mean > 0.75


def test_ranks_in_class_equal_a_sort(spark):
    rows = [(i, None if i % 7 == 0 else i % 3) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, y int")
    got = {r.id: (r.k, r.n) for r in ex.ranked_in_class(df, "id", "y", 5, "k", "n").collect()}
    import hashlib

    for y in (None, 0, 1, 2):
        ids = sorted((i for i, v in rows if v == y), key=lambda i: (hashlib.md5(f"5|{i}".encode()).hexdigest(), i))
        assert [got[i] for i in ids] == [(k + 1, len(ids)) for k in range(len(ids))]


@pytest.mark.parametrize("model,options", [("logistic", {}), ("svc", {"max_iter": 20}), ("forest", {"trees": 10}), ("extra_trees", {"trees": 20})])
def test_models_find_the_planted_signal(planted, model, options):
    got = {r.split: r.f1_macro for r in ex.scores(ml.predictions(planted, ["a", "b", "c"], "id", model, **options), ["split"]).collect()}
    assert got["test"] > 0.75


def test_extra_trees_importance_and_seed(planted):
    rows = ml.prepared(planted, ["a", "b", "c"]).filter("split = 'train'")
    a, b = (ml.extra_trees(rows, ["z_a", "z_b", "z_c"], "id", trees=30) for _ in range(2))
    assert len(a.fit.feature) == 30 and (a.fit.threshold == b.fit.threshold).all() and np.argmax(a.importances) == 0 and sum(a.importances) == pytest.approx(1)


def macro_f1(y, hat):
    f1 = [2 * ((y == c) & (hat == c)).sum() / max(1, (y == c).sum() + (hat == c).sum()) for c in (0, 1)]
    return np.mean(f1)


def test_permutation_null_of_every_model_on_all_test_rows(planted, monkeypatch):
    monkeypatch.setattr(ml, "FOREST_BLOCK", 7)
    plain = ml.bounded
    monkeypatch.setattr(ml, "bounded", lambda df, id_col: plain(df, id_col, 100))
    r = ml.permutation_null(planted, ["a", "b", "c"], "id", permutations=15, trees=20).collect()
    # linear models see all training rows, forests the bounded sample
    train = planted.filter("split = 'train'")
    drawn = linear_fits.with_permutations(train, "id", 15, 0).orderBy("id").toPandas()
    labels = np.unpackbits(np.stack([np.frombuffer(b, np.uint8) for b in drawn.bits]), axis=1)
    x, y = drawn[["a", "b", "c"]].to_numpy(), drawn["y"].to_numpy()
    xt, yt = matrix(planted, "test")
    for model in ml.MODELS:
        score = {x.perm_id: x.score for x in r if x.model == model}
        assert sorted(score) == list(range(-1, 15))
        true = macro_f1(yt, fits.fit(model, x, y, [0, 0], trees=20).predict(xt))
        assert score[-1] == pytest.approx(true) or model in ("forest", "extra_trees")
    for k in range(15):
        assert labels[:, k].sum() == y.sum()
        fit = fits.fit("logistic", x, labels[:, k], [0])
        assert next(v.score for v in r if v.model == "logistic" and v.perm_id == k) == pytest.approx(macro_f1(yt, fit.predict(xt)))


def test_fits_at_once_equal_separate_ones(spark, planted):
    """Folds and permutations of both losses, to 1e-8 (weights) and by their objective."""
    train = ex.stratified_folds(planted.filter("split = 'train'").withColumn("b", F.col("b") * 1000 + 5e4), "id", "y")
    rows = linear_fits.with_permutations(train, "id", 9, 3)
    jobs = [linear_fits.Job("logistic", k) for k in range(-1, 5)] + [linear_fits.Job("logistic", -1, k) for k in range(9)] + [linear_fits.Job("svc", 2), linear_fits.Job("svc", -1, 4)]
    made = linear_fits.fit_all(rows, ["a", "b", "c"], jobs)
    data = rows.orderBy("id").toPandas()
    labels = np.unpackbits(np.stack([np.frombuffer(b, np.uint8) for b in data.bits]), axis=1)
    for j, fit in zip(jobs, made):
        on = data.fold.to_numpy() != j.left_out
        x, y = data[["a", "b", "c"]].to_numpy()[on], (data.y.to_numpy() if j.permutation < 0 else labels[:, j.permutation])[on]
        own = fits.fit(j.loss, x, y, [0])
        assert np.allclose(fit.mean, own.mean) and np.allclose(fit.scale, own.scale)
        assert np.allclose(fit.beta, own.beta, atol=1e-8 if j.loss == "logistic" else 1e-4), j


@pytest.mark.parametrize("n", [1, 2, 10, 97, 1000])
def test_places_are_a_permutation(n):
    every = [linear_fits.place(np.arange(n), n, key).tolist() for key in range(4)]
    assert all(sorted(p) == list(range(n)) for p in every)
    assert n < 97 or len({tuple(p) for p in every}) == 4


def test_sigmoid_is_the_best_of_a_grid(spark, planted):
    rows = planted.withColumn("m", 2 * F.col("a") - 0.3 + F.col("b"))
    a, b = linear_fits.sigmoid_of_margins(rows, "m", "y")
    data = rows.toPandas()
    m, y = data.m.to_numpy(), data.y.to_numpy()
    t = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    loss = lambda a, b: (t * (a * m + b) + np.logaddexp(0, -(a * m + b))).sum()
    assert a < 0 and all(loss(a, b) <= loss(a + da, b + db) + 1e-9 for da in np.linspace(-1, 1, 21) for db in np.linspace(-1, 1, 21))


def test_probabilities_of_a_support_vector_machine_rise_with_its_margin(planted):
    got = ml.predictions(planted, ["a", "b", "c"], "id", "svc").orderBy("probability_1").toPandas()
    assert got.probability_1.between(0, 1).all() and got.yhat.is_monotonic_increasing and got.y[got.probability_1 > 0.8].mean() > 0.7


@pytest.mark.parametrize("kind", ["forest", "extra_trees"])
def test_trees_grown_by_aggregates_equal_plain_ones(spark, planted, kind):
    """Every tree against a plain growth, row by row, over the same bins and samples; any number of partitions."""
    rows = ex.stratified_folds(planted.filter("split = 'train'"), "id", "y")
    features, n = ["a", "b", "c"], 4
    jobs = [(kind, -1), (kind, 3)]
    made = tree_growth.grow_groves(rows.repartition(5), features, "id", jobs, n, 3, 7)
    cuts = tree_growth.bin_cuts(rows, features)
    data = rows.withColumn("key", F.xxhash64(F.col("id").cast("string"))).toPandas()
    codes = np.stack([np.searchsorted(c, data[f], side="left") for f, c in zip(features, cuts)], axis=1)
    weight = tree_growth.sample_weights(kind, data.key.to_numpy(), 7, np.arange(n))
    if kind == "forest":
        assert abs(weight.mean() - 1) < 0.1 and len(set(map(bytes, weight))) == n
    y = data.y.to_numpy()
    gini = lambda w0, w1: 2 * w0 * w1 / max(w0 + w1, 1e-300)
    for (_, out), fit in zip(jobs, made):
        for t in range(n):
            w = np.where(data.fold == out, 0, weight[t]).astype(float)
            both = [w[y == c].sum() for c in (0, 1)]
            w = w * np.where(y == 1, sum(both) / 2 / both[1], sum(both) / 2 / both[0])
            stack = [(0, np.flatnonzero(w))]
            while stack:
                k, on = stack.pop()
                w0, w1 = w[on][y[on] == 0].sum(), w[on][y[on] == 1].sum()
                assert fit.share[t, k] == pytest.approx(w1 / (w0 + w1))
                f = fit.feature[t, k]
                if f < 0:
                    assert k >= 7 or gini(w0, w1) < 1e-9 or all(len(set(codes[on, c])) < 2 for c in range(3))
                    continue
                right = data[features[f]].to_numpy()[on] > fit.threshold[t, k]
                assert 0 < right.sum() < len(on)

                def after(cut, on=on, f=f):
                    sides = [on[codes[on, f] <= cut], on[codes[on, f] > cut]]
                    return sum(gini(w[s][y[s] == 0].sum(), w[s][y[s] == 1].sum()) for s in sides)

                chosen = gini(w0, w1) - after(codes[on[~right], f].max())
                if kind == "forest":
                    assert chosen == pytest.approx(max(gini(w0, w1) - after(c) for c in range(codes[on, f].min(), codes[on, f].max())))
                stack += [(2 * k + 1, on[~right]), (2 * k + 2, on[right])]


def test_grid_is_the_published_one():
    assert len(ml.GRID) == 18 and len({r.name for r in ml.GRID}) == 18
    assert [len(r.features) for r in ml.GRID if r.name.startswith("without")] == [4] * 5
    assert next(r for r in ml.GRID if r.name == "H1-2").seed == 42


def test_counts_of_trees_are_few_numbers(spark, planted):
    """The last level counts classes alone; extremely randomised trees read equal rows once."""
    assert tree_growth._shape(5, 5, 4) == (32, 1, 1, 2) and tree_growth._shape(4, 5, 4) == (16, 4, tree_growth.BINS, 2)
    table = spark.createDataFrame([(k, k % 2, 0, b"ab") for k in range(40)], "key long, y int, fold int, bins binary")
    assert sorted(r.n for r in tree_growth.grove_rows(table, {"extra_trees"}).collect()) == [20, 20]
    assert tree_growth.grove_rows(table, {"forest", "extra_trees"}).count() == 42


def test_document_features_are_computed_once(spark):
    from draftmetrics.plans import order_plans as op

    plan = op.document_features(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "documents.parquet" not in plan and "scratch-" in plan or "text#" not in plan


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_order_features_exchange_no_row_thrice(spark):
    from draftmetrics.plans import order_plans as op

    assert "Expand" not in _plan(op.order_features(spark, "/root/testdata/sf0.001"))
    assert "lineitem" not in _plan(op.describe_features(spark, "/root/testdata/sf0.001"))  # from a table, for moments and quantiles


def test_feature_matrix_meets_each_table_once(spark):
    from draftmetrics.plans import order_plans as op

    assert _plan(op.feature_matrix(spark, "/root/testdata/sf0.001")).count("Join") <= 4


def test_split_deals_folds_by_the_same_ranks(planted):
    """Folds that come with a split are those of the training rows ranked on their own."""
    both = {r.id: (r.split, r.fold) for r in ex.stratified_split(planted.drop("split"), "id", "y", 3, folds=4).collect()}
    split = ex.stratified_split(planted.drop("split"), "id", "y", 3)
    alone = {r.id: ("train", r.fold) for r in ex.stratified_folds(split.filter("split = 'train'"), "id", "y", 4, 3).collect()} | {r.id: ("test", -1) for r in split.filter("split = 'test'").collect()}
    assert both == alone
