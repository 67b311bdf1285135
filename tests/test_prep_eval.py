"""Preparation steps, splits and evaluation metrics: edge cases and properties."""

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from loupe.operators import evaluate as G
from loupe.operators import prep as P
from loupe.operators import split as SP


def test_cap_keeps_null_and_remove_drops_it(spark):
    df = spark.createDataFrame([(1, 5.0), (2, None), (3, 100.0), (4, -50.0)], "k long, x double")
    capped = {r["k"]: r["x"] for r in P.cap_outliers(df, {"x": (0.0, 10.0)}).collect()}
    assert capped == {1: 5.0, 2: None, 3: 10.0, 4: 0.0}
    kept = {r["k"] for r in P.remove_outliers(df, {"x": (0.0, 10.0)}).collect()}
    assert kept == {1}


def test_group_rare_merges_existing_other(spark):
    rows = [("a",)] * 50 + [("Other",)] * 2 + [("b",)] * 2 + [(None,)] * 5   # b: 2/54 < 5 %
    df = spark.createDataFrame(rows, "c string")
    freq = P.fit_frequent_values(df, ["c"], 0.05)
    out = P.apply_group_rare(df, freq).groupBy("c").count().collect()
    got = {r["c"]: r["count"] for r in out}
    assert got == {"a": 50, "Other": 4, None: 5}


def test_one_hot_drops_first_sorted_category(spark):
    df = spark.createDataFrame([("z",), ("a",), ("m",), (None,)], "c string")
    cats = P.fit_one_hot(df, ["c"])
    out = P.apply_one_hot(df, cats)
    assert out.columns == ["c_m", "c_z"]
    assert [tuple(r) for r in out.collect()] == [(0, 1), (0, 0), (1, 0), (0, 0)]


def test_label_encoding_null_as_nan_string(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("b",)], "c string")
    out = [r["c"] for r in P.label_encode(df, ["c"]).orderBy(F.monotonically_increasing_id()).collect()]
    assert sorted(set(out)) == [0, 1, 2]
    d = {r["value"]: r["code"] for r in P.label_dictionary(df, "c").collect()}
    assert d == {"a": 0, "b": 1, "nan": 2}


def test_imputers(spark):
    df = spark.createDataFrame([(1.0, "x"), (2.0, "y"), (3.0, "y"), (10.0, None), (None, "x")],
                               "n double, s string")
    assert P.fit_numeric_imputer(df, ["n"], "median") == {"n": 2.5}
    assert P.fit_numeric_imputer(df, ["n"], "mean") == {"n": 4.0}
    assert P.fit_categorical_imputer(df, ["s"]) == {"s": "x"}   # tie -> smallest


def test_stratified_split_sizes_and_stability(spark):
    rows = [(i, 1 if i % 7 == 0 else 0) for i in range(1000)]
    df = spark.createDataFrame(rows, "k long, y int")
    a = SP.stratified_split(df.repartition(3), "y", ["k"], 0.2).toPandas()
    b = SP.stratified_split(df.repartition(7), "y", ["k"], 0.2).toPandas()
    assert (a.sort_values("k")["split"].to_numpy() == b.sort_values("k")["split"].to_numpy()).all()
    t = a[a.split == "test"]
    assert len(t) == math.ceil(0.2 * 1000)
    share = t.y.mean()
    assert abs(share - a.y.mean()) < 0.01


def test_undersample_balances(spark):
    rows = [(i, 1 if i % 5 == 0 else 0) for i in range(500)]
    out = SP.undersample(spark.createDataFrame(rows, "k long, y int"), "y", ["k"])
    counts = {r["y"]: r["count"] for r in out.groupBy("y").count().collect()}
    assert counts == {0: 100, 1: 100}


def _brute_auc(y, s):
    pos = [si for yi, si in zip(y, s) if yi == 1]
    neg = [si for yi, si in zip(y, s) if yi == 0]
    tot = sum((1.0 if p > n else 0.5 if p == n else 0.0) for p in pos for n in neg)
    return tot / (len(pos) * len(neg))


def test_auc_matches_brute_force_with_ties(spark):
    rng = np.random.default_rng(3)
    y = rng.integers(0, 2, 400)
    s = np.round(rng.random(400) * 0.3 + y * 0.2, 1)   # heavy ties
    df = spark.createDataFrame(pd.DataFrame({"label": y, "score": s}))
    got = G.auc(df, None, "label", "score").collect()[0]["auc"]
    assert math.isclose(got, _brute_auc(y, s), rel_tol=1e-12)


def test_class_metrics_sum_to_confusion_and_mcc(spark):
    rng = np.random.default_rng(5)
    y = rng.integers(0, 3, 300)
    p = np.where(rng.random(300) < 0.7, y, rng.integers(0, 3, 300))
    df = spark.createDataFrame(pd.DataFrame({"label": y, "prediction": p}))
    cm = G.confusion_matrix(df).toPandas()
    pc = G.class_metrics(df).toPandas()
    assert cm["count"].sum() == 300 and pc["tp"].sum() == np.trace(
        pd.crosstab(y, p).to_numpy())
    assert (pc["tp"] + pc["fp"] + pc["fn"] + pc["tn"] == 300).all()
    c = np.trace(pd.crosstab(y, p).to_numpy())
    t = np.bincount(y, minlength=3)
    q = np.bincount(p, minlength=3)
    exp = (c * 300 - (t * q).sum()) / math.sqrt((300 ** 2 - (q ** 2).sum()) * (300 ** 2 - (t ** 2).sum()))
    got = G.mcc(df).collect()[0]["mcc"]
    assert math.isclose(got, exp, rel_tol=1e-12)


def test_mcc_degenerate_is_zero(spark):
    df = spark.createDataFrame([(1, 1)] * 10, "label int, prediction int")
    assert G.mcc(df).collect()[0]["mcc"] == 0.0


def test_roc_points_start_at_origin_and_end_at_one(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.8), (1, 0.7), (0, 0.1)], "label int, score double")
    pts = G.roc_points(df).toPandas()
    assert ((pts.fpr == 0) & (pts.tpr == 0)).any()
    assert ((pts.fpr == 1) & (pts.tpr == 1)).any()


def test_macro_roc_matches_numpy_interp(spark):
    rng = np.random.default_rng(11)
    n = 300
    y = rng.integers(0, 3, n)
    raw = np.round(rng.random((n, 3)), 1) + np.eye(3)[y] * 0.3
    p = raw / raw.sum(1, keepdims=True)
    pdf = pd.DataFrame({"label": y, "p0": p[:, 0], "p1": p[:, 1], "p2": p[:, 2]})
    got = G.roc_macro(spark.createDataFrame(pdf), ["p0", "p1", "p2"]).toPandas().sort_values("fpr")
    fprs, tprs = [], []
    for c in range(3):
        yc = (y == c).astype(int)
        s = p[:, c]
        order = np.argsort(-s, kind="mergesort")
        ys, ss = yc[order], s[order]
        last = np.r_[np.where(np.diff(ss))[0], len(ss) - 1]
        tp, fp = np.cumsum(ys)[last], np.cumsum(1 - ys)[last]
        fprs.append(np.r_[0, fp / fp[-1]])
        tprs.append(np.r_[0, tp / tp[-1]])
    grid = np.unique(np.concatenate(fprs))
    mean = np.mean([np.interp(grid, f, t) for f, t in zip(fprs, tprs)], axis=0)
    assert len(got) == len(grid)
    assert np.allclose(got.fpr.to_numpy(), grid) and np.allclose(got.tpr.to_numpy(), mean)
    assert math.isclose(got.auc_macro.iloc[0], np.trapezoid(mean, grid), rel_tol=1e-12)


def test_guards_refuse_tiny_tables_and_null_targets(spark):
    import pytest

    from loupe.plans.workflow import train_models
    tiny = spark.createDataFrame([(i, i % 2) for i in range(5)], "x long, y int")
    with pytest.raises(ValueError):
        P.check_trainable(tiny, "y")
    bad = spark.createDataFrame([(1.0, None, 1), (2.0, 1, 2)], "x double, y int, k long")
    with pytest.raises(ValueError):
        train_models(bad, bad, ["x"], "y", "k", names=["rule_based"])


def test_train_median_fills_both_sides(spark):
    from loupe.operators.models import impute_train_median
    tr = spark.createDataFrame([(1.0,), (3.0,), (None,)], "x double")
    te = spark.createDataFrame([(None,), (10.0,)], "x double")
    a, b = impute_train_median(tr, te, ["x"])
    assert sorted(r["x"] for r in b.collect()) == [2.0, 10.0]
    assert sorted(r["x"] for r in a.collect()) == [1.0, 2.0, 3.0]


def test_sparse_one_hot_takes_any_number_of_categories(spark):
    df = spark.range(100_000).select(F.col("id"), F.concat(F.lit("v"), F.col("id")).alias("key.x"), F.when(F.col("id") % 3 > 0, F.concat(F.lit("c"), F.col("id") % 3)).alias("c"), F.lit("one").alias("const"))
    fitted = P.fit_one_hot_sparse(df, ["key.x", "c", "const"])
    assert fitted.sizes == {"key.x": 99_999, "c": 1, "const": 0} and fitted.offsets == {"key.x": 0, "c": 99_999, "const": 100_000}
    got = P.apply_one_hot_sparse(df, fitted)
    assert got.columns == ["id", "one_hot"]
    rank = {f"v{i}": r for r, i in enumerate(sorted(range(100_000), key=lambda i: f"v{i}"))}
    rows = {r.id: r.one_hot for r in got.where("id % 9973 = 0 OR id < 5").collect()}
    for i, at in rows.items():
        assert at == [rank[f"v{i}"] - 1] * (rank[f"v{i}"] > 0) + [99_999] * (i % 3 == 2)
    unseen = spark.createDataFrame([(1, "nobody", "c2", "one")], df.schema)
    assert P.apply_one_hot_sparse(unseen, fitted).first().one_hot == [99_999]
