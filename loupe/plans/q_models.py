"""Model queries (F1-F10) on the planted-rule lineitem table and on embeddings."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loupe.operators import linear_path as LP
from loupe.operators import models as M
from loupe.operators import split as SP
from loupe.plans.catalog import register
from loupe.plans.fixtures import dirty_orders, planted_lineitem
from loupe.plans.q_prep import PLANTED_FEATURES
from loupe.sources.tables import load

OUT = ["row_key", "label", "prediction", "p0", "p1", "score"]


def _planted(spark, sf):
    d = planted_lineitem(spark, sf)
    return d.where(F.col("split") == "train"), d.where(F.col("split") == "test")


@register("q_model_majority")
def q_model_majority(spark, sf):
    """the rule-based model = train mode, probabilities .8/.2, on the planted test rows."""
    train, test = _planted(spark, sf)
    return M.predict_majority(test, M.fit_majority(train, "label"), 2).select(*OUT)


@register("q_model_gnb")
def q_model_gnb(spark, sf):
    """Gaussian naive Bayes (var_smoothing 1e-9) predictions on the planted test rows."""
    train, test = _planted(spark, sf)
    m = M.fit_gnb(train, PLANTED_FEATURES, "label", 1e-9)
    return M.predict_gnb(test, m).select("row_key", "label", "prediction")


def _embeddings(spark, sf):
    e = load(spark, sf, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"),
        F.col("label").cast("long").alias("label"))
    test = F.col("id") % 5 == 0
    return e.where(~test), e.where(test)


@register("q_model_knn")
def q_model_knn(spark, sf):
    """exact 5-NN (euclidean, uniform vote) of the held-out embeddings."""
    train, test = _embeddings(spark, sf)
    cand = M.knn_candidates(train, test, 5, "euclidean")
    pred = M.knn_vote(cand, 5, "uniform")
    return test.select(F.col("id").alias("row_id"), "label").join(
        pred.withColumnRenamed("test_id", "row_id"), "row_id")


def _scaled(spark, sf):
    """The planted rows scaled as the reference does before it trains (standard scaler fitted on train)."""
    from loupe.operators import scale as S
    train, test = _planted(spark, sf)
    sp = S.fit_standard(train, PLANTED_FEATURES)
    return S.apply_standard(train, sp), S.apply_standard(test, sp)


def _mllib(spark, sf, name, **params):
    train, test = _planted(spark, sf)
    return M.predict_mllib(M.fit_mllib(train, PLANTED_FEATURES, name, "label", **params), test, 2).select(*OUT)


@register("q_model_logreg")
def q_model_logreg(spark, sf):
    """logistic regression (C = 1) on the scaled planted rule."""
    train, test = _scaled(spark, sf)
    return LP.predict(test, LP.fit_logistic(train, PLANTED_FEATURES, "label", 2), 2).select(*OUT)


def _certificate(train, model, slope, c):
    """Per weight and intercept: whether the objective's slope, taken anew from all train rows, is nearly zero.

    ``slope``: derivative of a row's loss by its margin. Rows count C each, weights half their square; both sides are divided by C times the rows.
    """
    margin = LP.margins(model)[0]
    y = F.col("label")
    terms = [*[(f, F.col(f)) for f in model.features], ("intercept", F.lit(1.0))]
    r = train.agg(F.count(F.lit(1)).alias("n"), *[F.avg(slope(margin, y) * x).alias(t) for t, x in terms]).first()
    w = dict(zip(model.features, model.weights[:, 0]))
    rows = [(t, bool(abs(r[t] + w.get(t, 0.0) / (c * r["n"])) < 2e-3)) for t, _ in terms]
    return train.sparkSession.createDataFrame(rows, "term string, at_optimum boolean")


@register("q_logreg_certificate")
def q_logreg_certificate(spark, sf):
    """the gradient of the logistic objective vanishes at the fitted weights (scaled planted rule, C = 1)."""
    train, _ = _scaled(spark, sf)
    model = LP.fit_logistic(train, PLANTED_FEATURES, "label", 2)
    return _certificate(train, model, lambda m, y: 1.0 / (1.0 + F.exp(-m)) - y, 1.0)


@register("q_svm_certificate")
def q_svm_certificate(spark, sf):
    """the gradient of the rounded hinge objective vanishes at the fitted weights (scaled planted rule, C = 1)."""
    train, _ = _scaled(spark, sf)
    model = LP.fit_svm(train, PLANTED_FEATURES, "label", 2)

    def slope(m, y):
        sign = 2 * y - 1
        return -sign * F.greatest(F.lit(0.0), F.least(F.lit(1.0), (1 - sign * m) / LP.ROUND))

    return _certificate(train, model, slope, 1.0)


@register("q_tree_root")
def q_tree_root(spark, sf):
    """feature and threshold of the fitted tree's first split (largest fall of Gini impurity) on the planted rule."""
    from loupe.operators.forest_path import nodes_of
    train, _ = _planted(spark, sf)
    fitted = M.fit_mllib(train, PLANTED_FEATURES, "decision_tree", maxDepth=2)
    nodes = nodes_of(fitted.model, spark)
    return spark.createDataFrame([(PLANTED_FEATURES[int(nodes.feature[0])], round(float(nodes.threshold[0]), 6))], "feature string, threshold double")


@register("q_model_tree")
def q_model_tree(spark, sf):
    """decision tree (unbounded depth -> 30, min split 2) on the planted rule."""
    return _mllib(spark, sf, "decision_tree")


@register("q_model_forest")
def q_model_forest(spark, sf):
    """random forest (100 trees, sqrt features) on the planted rule."""
    return _mllib(spark, sf, "random_forest", numTrees=100, maxDepth=30)


@register("q_model_svm")
def q_model_svm(spark, sf):
    """linear SVM (C = 1) with Platt-scaled probabilities on the scaled planted rule."""
    train, test = _scaled(spark, sf)
    return LP.predict(test, LP.fit_svm(train, PLANTED_FEATURES, "label", 2), 2).select(*OUT)


def _search(spark, sf, name, n_draws=None, scaled=False):
    train, _ = _scaled(spark, sf) if scaled else _planted(spark, sf)
    folds = int(SP.fold_count(train, "label").collect()[0]["folds"])
    train = train.withColumn("rid", F.xxhash64("row_key"))
    every = M.search_scores(train, PLANTED_FEATURES, name, "label", "rid", folds, 2, n_draws=n_draws)
    df = spark.createDataFrame([(name, ",".join(f"{k}={v}" for k, v in p.items()), f) for p, f in every],
                               "model string, params string, mean_f1 double")
    return df.select("*", F.row_number().over(
        Window.orderBy(F.col("mean_f1").desc(), F.col("params"))).alias("rank"))


@register("q_grid_search")
def q_grid_search(spark, sf):
    """F8: stratified 5-fold grid search of logistic regression C, scored by weighted F1."""
    return _search(spark, sf, "logistic_regression")


@register("q_random_search")
def q_random_search(spark, sf):
    """10 seeded draws from the 24-point decision-tree grid, 5-fold CV."""
    return _search(spark, sf, "decision_tree", n_draws=10)


@register("q_forest_search")
def q_forest_search(spark, sf):
    """F5 + F8: the 36-point random forest grid on the planted rule, stratified CV."""
    return _search(spark, sf, "random_forest")


@register("q_svm_search")
def q_svm_search(spark, sf):
    """F6 + F8: the 12-point SVM grid (both kernels, both gammas) on the scaled planted rule, stratified CV."""
    return _search(spark, sf, "svm", scaled=True)


@register("q_cv_folds")
def q_cv_folds(spark, sf):
    """fold count from the smallest class of dirty_orders.target."""
    return SP.fold_count(dirty_orders(spark, sf), "target")


@register("q_cv_fold_assignment")
def q_cv_fold_assignment(spark, sf):
    """stratified 5-fold assignment of dirty_orders in seeded hash order."""
    d = dirty_orders(spark, sf).select("o_orderkey", "target")
    return SP.cv_folds(d, "target", ["o_orderkey"], 5, 42)


@register("q_train_all_models")
def q_train_all_models(spark, sf):
    """F1-F7 + G16: every model with default settings on the scaled planted rule,
    compared on the test rows (time = measured fit+predict seconds); an error if any model fails."""
    from loupe.operators import ranking as R
    from loupe.plans.workflow import train_models
    train, test = _scaled(spark, sf)
    train = train.withColumn("rid", F.xxhash64("row_key"))
    test = test.withColumn("rid", F.xxhash64("row_key"))
    got = train_models(train, test, PLANTED_FEATURES, "label", "rid").complete()
    times = got.status.select("model", "training_time")
    return R.rank_models(R.leaderboard(got.predictions, ["model"], times))


def _train_status(spark, sf, names):
    from loupe.operators import scale as S
    from loupe.operators.balance import with_weights
    from loupe.plans.workflow import train_models
    # a rule of two features: the planted rows, and the others cut by the discount
    three = F.when(F.col("label") == 1, 2).otherwise((F.col("l_discount") > 0.04).cast("int"))
    train, test = (d.withColumn("label", three).withColumn("rid", F.xxhash64("row_key")) for d in _planted(spark, sf))
    sp = S.fit_standard(train, PLANTED_FEATURES)
    train, test = S.apply_standard(train, sp), S.apply_standard(test, sp)
    train = with_weights(train, "label")
    got = train_models(train, test, PLANTED_FEATURES, "label", "rid", weight="weight", names=(*names, "rule_based"))
    p = got.predictions.groupBy("model").agg(F.count(F.lit(1)).alias("n_rows"), F.avg((F.col("label") == F.col("prediction")).cast("double")).alias("accuracy"))
    base = F.max(F.when(F.col("model") == "rule_based", F.col("accuracy"))).over(Window.partitionBy())
    p = p.withColumn("beats_majority", F.col("accuracy") > base)
    # left: a failed model has a status row and no predictions
    return got.status.join(p, "model", "left").select("model", "status", "n_classes", "n_rows", "beats_majority")


@register("q_train_status")
def q_train_status(spark, sf):
    """one status row per model on three classes with class weights (a rule of two of the four scaled features)."""
    return _train_status(spark, sf, ("logistic_regression", "decision_tree", "naive_bayes"))


@register("q_train_status_more")
def q_train_status_more(spark, sf):
    """the rows of q_train_status for the three slow models (and the majority that they are held against)."""
    return _train_status(spark, sf, ("knn", "random_forest", "svm"))


@register("q_model_svm_rbf")
def q_model_svm_rbf(spark, sf):
    """F6 (rbf): SVM on 100 random Fourier features of the scaled planted rule, gamma='scale'."""
    train, test = _scaled(spark, sf)
    rff = M.rff_params(train, PLANTED_FEATURES, "scale", 100, 42)
    return LP.predict(test, LP.fit_svm(train, PLANTED_FEATURES, "label", 2, rff=rff), 2).select(*OUT)


@register("q_knn_search")
def q_knn_search(spark, sf):
    """F2 + F8: the 16-point kNN grid on the embeddings' training rows, 5-fold stratified CV."""
    train, _ = _embeddings(spark, sf)
    folds = int(SP.fold_count(train, "label").collect()[0]["folds"])
    data = SP.cv_folds(train, "label", ["id"], folds, 42, "fold")
    res = M.knn_search(data, folds)
    return _ranked(res)


def _ranked(res):
    """Settings by mean F1 to 9 decimals (sums of equal parts may differ beyond), then by name; a row per setting."""
    res = res.select("setting", F.round("mean_f1", 9).alias("mean_f1"))
    return res.select("*", F.row_number().over(Window.orderBy(F.col("mean_f1").desc(), F.col("setting"))).alias("rank"))


@register("q_gnb_search")
def q_gnb_search(spark, sf):
    """F4 + F8: the four var_smoothing values on the planted rule, stratified CV."""
    train, _ = _planted(spark, sf)
    folds = int(SP.fold_count(train, "label").collect()[0]["folds"])
    data = SP.cv_folds(train, "label", ["row_key"], folds, 42, "fold")
    return _ranked(M.gnb_search(data, PLANTED_FEATURES, "label", folds))
