"""Trees fitted in shared passes: MLlib's trees, counted rows, bounded work."""

import numpy as np
import pytest
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from loupe.operators import forest_path as FP
from loupe.operators import models as M
from loupe.operators import tree_path as T


def _frame(spark, n=1200):
    rng = np.random.default_rng(9)
    x = np.stack([rng.integers(0, 6, n), rng.integers(0, 4, n), rng.normal(size=n)], 1).astype(float)
    y = ((x[:, 0] > 2) & (x[:, 2] > 0)).astype(int) + (rng.random(n) < 0.1)
    return spark.createDataFrame([(*map(float, a), int(c)) for a, c in zip(x, y)], "a double, b double, c double, label int"), x, y


def test_a_tree_is_the_one_of_mllib(spark):
    df, x, _ = _frame(spark)
    vectors = df.select(array_to_vector(F.array("a", "b", "c")).alias("features"), F.col("label").cast("double").alias("label")).coalesce(1)
    for impurity, least in (("gini", 1), ("entropy", 5)):
        theirs = DecisionTreeClassifier(seed=42, maxBins=256, maxDepth=7, impurity=impurity, minInstancesPerNode=least).fit(vectors)
        ours = M.fit_mllib(df, ["a", "b", "c"], "decision_tree", maxDepth=7, impurity=impurity, minInstancesPerNode=least)
        want = np.array([r.probability.toArray() for r in theirs.transform(vectors).collect()])
        got = np.array([[r.p0, r.p1, r.p2] for r in M.predict_mllib(ours, df.coalesce(1), 3).collect()])
        assert np.allclose(want, got)


def test_equal_rows_are_one_row_with_a_count(spark):
    """A table 40 times over costs the blocks of one, and its tree is the same; forests of folds share the passes."""
    df, x, y = _frame(spark, 300)
    df = df.withColumn("c", F.round("c", 1))
    more = df.crossJoin(spark.range(40)).drop("id")
    one, many = (T.binned(d, ["a", "b", "c"], "label") for d in (df, more))
    held = lambda b: b.rows.agg(F.sum("n")).first()[0]
    assert held(one) == held(many) <= 300
    trees = [T.fit(b, [T.Spec(depth=6)])[0] for b in (one, many)]
    assert np.array_equal(trees[0].threshold, trees[1].threshold) and np.allclose(trees[0].share, trees[1].share)
    forest = T.fit(many, [T.Spec(30, 6, 1, 2, "gini", True, f) for f in (-1, 0)])
    assert all(len(f.roots) == 30 for f in forest) and len({len(r) for r in np.split(forest[0].left, forest[0].roots[1:])}) > 1
    says = next(FP.votes(forest[0], np.array([[r.a, r.b, r.c] for r in df.collect()]), [6], [30]))[2]
    assert (says == y).mean() > 0.85


def test_missing_features_are_refused(spark):
    for bad in (None, float("inf")):
        df = spark.createDataFrame([(1.0, 0), (2.0, 1), (bad, 1)], "a double, label int")
        with pytest.raises(ValueError, match="missing"):
            M.fit_mllib(df, ["a"], "decision_tree")
