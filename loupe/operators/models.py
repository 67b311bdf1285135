"""Classifiers.

* decision tree, random forest: by MLlib's rules, many fits in shared passes over binned rows, see :mod:`loupe.operators.tree_path`;
* logistic regression, SVM (linear, and RBF by random features): many fits in shared passes, see
  :mod:`loupe.operators.linear_path`;
* Gaussian naive Bayes and the majority ("rule-based") model: one grouped
  aggregate for the fit, Column expressions for prediction;
* k-nearest neighbours: exact, by an index of pivots, see :mod:`loupe.operators.neighbours`.

All ``predict_*`` functions return the input rows plus ``prediction`` and one
``p<k>`` probability column per class; ``score`` is ``p1`` for binary labels.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loupe.functions.names import all_named, named
from loupe.functions.stats import as_double, is_missing
from loupe.operators.neighbours import knn_candidates
from loupe.session import materialize

# Probabilities of the reference's rule-based classifier.
MAJORITY_P = 0.8
MAJORITY_REST = 0.2


def _with_probs(df: DataFrame, probs: list, prediction) -> DataFrame:
    cols = [prediction.alias("prediction"), *[p.alias(f"p{i}") for i, p in enumerate(probs)]]
    out = df.select("*", *cols)
    if len(probs) == 2:
        out = out.withColumn("score", F.col("p1"))
    return out


def by_class(df: DataFrame, classes: Sequence, n_classes: int) -> DataFrame:
    """Probabilities of a model that knows only ``classes`` in the places of all ``n_classes``."""
    if list(classes) == list(range(n_classes)):
        return df
    own = {int(c): F.col(f"p{i}") for i, c in enumerate(classes)}
    keep = [c for c in df.columns if c not in {f"p{i}" for i in range(max(2, n_classes))} and c != "score"]
    probs = [own.get(i, F.lit(0.0)).alias(f"p{i}") for i in range(max(2, n_classes))]
    out = df.select(*keep, *probs)
    return out.withColumn("score", F.col("p1")) if n_classes <= 2 else out


# ---------------------------------------------------------------- F7 majority

def fit_majority(train: DataFrame, label: str) -> int:
    """every rule of the reference's classifier votes the train mode, so it
    always predicts the most frequent class (smallest on ties)."""
    c = train.groupBy(named(label)).count()
    best = c.orderBy(F.col("count").desc(), named(label)).limit(1).collect()
    return int(best[0][label])


def predict_majority(df: DataFrame, mode: int, n_classes: int = 2) -> DataFrame:
    k = max(2, n_classes if n_classes > 2 else 2)
    rest = MAJORITY_REST / (k - 1)
    probs = [F.lit(MAJORITY_P if i == mode else rest) for i in range(k)]
    return _with_probs(df, probs, F.lit(mode))


# ---------------------------------------------------------------- F4 Gaussian NB

@dataclass
class GaussianNB:
    classes: list
    priors: list[float]
    means: list[list[float]]
    variances: list[list[float]]
    features: list[str]


def fit_gnb(train: DataFrame, features: Sequence[str], label: str,
            var_smoothing: float = 1e-9) -> GaussianNB:
    """per-class means and population variances + smoothing * max feature variance."""
    features = list(features)
    glob = train.agg(*[F.var_pop(as_double(f)).alias(f) for f in features]).collect()[0]
    eps = var_smoothing * max(float(glob[f] or 0.0) for f in features)
    rows = train.groupBy(named(label)).agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.avg(as_double(f)).alias(f"m_{f}") for f in features],
        *[F.var_pop(as_double(f)).alias(f"v_{f}") for f in features]).orderBy(label).collect()
    n = sum(r["_n"] for r in rows)
    return GaussianNB(
        classes=[r[label] for r in rows], priors=[r["_n"] / n for r in rows],
        means=[[float(r[f"m_{f}"]) for f in features] for r in rows],
        variances=[[float(r[f"v_{f}"]) + eps for f in features] for r in rows],
        features=features)


def predict_gnb(df: DataFrame, m: GaussianNB) -> DataFrame:
    """Joint log-likelihood per class; argmax (first class on ties); softmax probabilities."""
    jll = []
    for ci in range(len(m.classes)):
        e = F.lit(math.log(m.priors[ci]) - 0.5 * sum(math.log(2 * math.pi * v)
                                                    for v in m.variances[ci]))
        for f, mu, var in zip(m.features, m.means[ci], m.variances[ci]):
            e = e - F.pow(as_double(f) - F.lit(mu), 2) / F.lit(2 * var)
        jll.append(e)
    best = F.greatest(*[F.struct(j.alias("ll"), F.lit(-i).alias("neg_i")) for i, j in enumerate(jll)])
    x = df.select("*", *[j.alias(f"_jll{i}") for i, j in enumerate(jll)],
                  (-best["neg_i"]).alias("_bi"))
    mx = F.greatest(*[F.col(f"_jll{i}") for i in range(len(jll))])
    exps = [F.exp(F.col(f"_jll{i}") - mx) for i in range(len(jll))]
    tot = exps[0]
    for e in exps[1:]:
        tot = tot + e
    classes = F.array(*[F.lit(c) for c in m.classes])
    out = _with_probs(x, [e / tot for e in exps], classes[F.col("_bi")])
    return out.drop(*[f"_jll{i}" for i in range(len(jll))], "_bi")


# ---------------------------------------------------------------- F2 k-nearest neighbours

def vote_weight(weights: str):
    """Weight of a neighbour: 1, or 1/distance; where a test row has neighbours at distance 0
    only those count. Needs ``dist`` and ``_least`` (the test row's smallest distance)."""
    if weights == "uniform":
        return F.lit(1.0)
    exact = F.col("_least") == 0
    return F.when(exact, (F.col("dist") == 0).cast("double")).otherwise(F.try_divide(F.lit(1.0), F.col("dist")))


def knn_vote(cand: DataFrame, k: int, weights: str = "uniform", n_classes: int = 0) -> DataFrame:
    """``test_id, prediction`` by the vote of the k nearest; ties go to the smallest class.

    With ``n_classes`` also each class's share of the votes, ``p0 ..``.
    """
    c = cand.where(F.col("nb_rank") <= k)
    c = c.withColumn("_least", F.min("dist").over(Window.partitionBy("test_id")))
    votes = c.groupBy("test_id", "nb_label").agg(F.sum(vote_weight(weights)).alias("v"))
    best = F.max_by("nb_label", F.struct("v", (-F.col("nb_label")).alias("n"))).alias("prediction")
    shares = [F.coalesce(F.try_divide(F.sum(F.when(F.col("nb_label") == i, F.col("v"))), F.sum("v")), F.lit(0.0)).alias(f"p{i}")
              for i in range(n_classes)]
    return votes.groupBy("test_id").agg(best, *shares)


# ---------------------------------------------------------------- F3/F5 trees

@dataclass
class FittedModel:
    """A fitted tree or forest (its node table) and the columns it reads."""
    model: object
    features: list[str]


def spec_of(name: str, n_features: int, left_out: int = -1, **params):
    """A tree's or forest's parameters (in Spark's names) for :mod:`loupe.operators.tree_path`."""
    from loupe.operators.forest_path import features_per_node
    from loupe.operators.tree_path import Spec

    if name not in ("decision_tree", "random_forest"):
        raise ValueError(f"unknown model {name!r}")
    forest = name == "random_forest"
    per_node = features_per_node(params.get("featureSubsetStrategy", "sqrt"), n_features) if forest else 0
    return Spec(params.get("numTrees", 100) if forest else 1, params.get("maxDepth", MAX_DEPTH), params.get("minInstancesPerNode", 1),
                per_node, params.get("impurity") or "gini", forest, left_out)


def fit_mllib(train: DataFrame, features: Sequence[str], name: str, label: str = "label",
              weight: str | None = None, bins=None, **params) -> FittedModel:
    """A decision tree or random forest by MLlib's rules; the fit is :mod:`loupe.operators.tree_path`'s. ``bins``: the binned rows, if they were made before."""
    from loupe.operators import tree_path

    rows = bins.open() if bins else tree_path.binned(train, features, label, None, None, weight)
    try:
        return FittedModel(tree_path.fit(rows, [spec_of(name, len(features), **params)])[0], list(features))
    finally:
        rows.close()


class Shared:
    """Forms of the training rows that several models read, each made when the first of them asks for it."""

    def __init__(self, train: DataFrame, features: Sequence[str], label: str, n_classes: int, weight: str | None = None):
        self._of = train, list(features), label
        self._n_classes, self._weight = n_classes, weight
        self._bins = self._blocks = None

    def bins(self):
        """For trees and forests."""
        from loupe.operators import tree_path

        self._bins = self._bins or tree_path.binned(*self._of, None, None, self._weight)
        return self._bins

    def blocks(self):
        """For logistic regression and the linear SVM."""
        from loupe.operators import linear_path as LP

        self._blocks = self._blocks or LP.blocks_of(*self._of, self._n_classes, LP.sigmoid_folds(self._of[1]), self._weight)
        return self._blocks


def predict_mllib(fitted: FittedModel, df: DataFrame, n_classes: int) -> DataFrame:
    """Predictions with ``p<k>`` columns: the mean class shares of the trees' leaves."""
    from loupe.operators.forest_path import shares

    nodes, d = df.sparkSession.sparkContext.broadcast(fitted.model), len(fitted.features)
    k = max(2, n_classes)

    def of_rows(x):
        import pyarrow as pa

        values = x.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
        out = [np.zeros((0, k))]
        for s in range(0, len(values), 2048):
            total = next(shares(nodes.value, values[s:s + 2048], [MAX_DEPTH], [len(nodes.value.roots)]))[2]
            total = total / total.sum(1, keepdims=True)
            out.append(np.concatenate([total, np.zeros((len(total), max(0, k - total.shape[1])))], 1)[:, :max(k, total.shape[1])])
        flat = np.concatenate(out)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1) * flat.shape[1], pa.int32()), pa.array(flat.ravel()))

    values = F.array(*[F.coalesce(named(f).cast("double"), F.lit(float("nan"))) for f in fitted.features])
    rows = df.select(F.struct(*all_named(df.columns)).alias("_in"), F.arrow_udf(of_rows, "array<double>")(values).alias("_p"))
    best = (F.array_position("_p", F.array_max("_p")) - 1).cast("int")  # ties: the smallest class
    res = rows.select("_in.*", best.alias("prediction"), *[F.col("_p")[i].alias(f"p{i}") for i in range(k)])
    return res.withColumn("score", F.col("p1")) if n_classes <= 2 else res


def impute_train_median(train: DataFrame, test: DataFrame, features: Sequence[str]):
    """features still holding nulls are filled with the *train* median."""
    from loupe.operators.prep import apply_numeric_imputer, fit_numeric_imputer
    some = lambda df: df.agg(*[F.max(is_missing(df, f)).alias(f) for f in features]).first().asDict()
    a, b = some(train), some(test)
    nulls = [f for f in features if a[f] or b[f]]
    if not nulls:
        return train, test
    fills = fit_numeric_imputer(train, nulls, "median")
    return apply_numeric_imputer(train, fills, nulls), apply_numeric_imputer(test, fills, nulls)


# ---------------------------------------------------------------- F6 RBF kernel (approximate)

def rff_params(train: DataFrame, features: Sequence[str], gamma: str | float = "scale",
               n_components: int = 100, seed: int = 42) -> dict:
    """Random Fourier features for the RBF kernel exp(-gamma |x - y|^2) (Rahimi & Recht).

    ``gamma="scale"`` is 1 / (d * Var(X)) over all feature values, ``"auto"``
    is 1 / d. Weights are drawn on the driver from a seeded generator: a
    d x D matrix, independent of the row count.
    """
    features = list(features)
    d = len(features)
    if gamma == "scale":
        cells = F.explode(F.array(*[as_double(f) for f in features]))
        var = train.select(cells.alias("v")).agg(F.var_pop("v")).collect()[0][0] or 0.0
        g = 1.0 / (d * var) if var > 0 else 1.0
    elif gamma == "auto":
        g = 1.0 / d
    else:
        g = float(gamma)
    rng = np.random.default_rng(seed)
    w = rng.normal(0.0, math.sqrt(2.0 * g), size=(d, n_components))
    b = rng.uniform(0.0, 2.0 * math.pi, size=n_components)
    return {"features": features, "w": w.tolist(), "b": b.tolist(), "gamma": g}


def apply_rff(df: DataFrame, p: dict, prefix: str = "rff") -> tuple[DataFrame, list[str]]:
    """Adds ``sqrt(2/D) cos(x . w_j + b_j)`` columns (Column expressions, codegen'd)."""
    feats, w, b = p["features"], p["w"], p["b"]
    n = len(b)
    scale = math.sqrt(2.0 / n)
    cols, names = [], []
    for j in range(n):
        dot = F.lit(b[j])
        for i, f in enumerate(feats):
            dot = dot + as_double(f) * F.lit(w[i][j])
        names.append(f"{prefix}_{j}")
        cols.append((F.lit(scale) * F.cos(dot)).alias(names[-1]))
    return df.select("*", *cols), names


# ---------------------------------------------------------------- F2/F4 searches (fold-based)

def _f1_by_setting(pred: DataFrame) -> DataFrame:
    """Weighted F1 per ``setting`` from ``setting, fold, label, prediction`` rows (mean over folds)."""
    from loupe.operators.evaluate import basic_metrics
    m = basic_metrics(pred, ["setting", "fold"])
    return m.groupBy("setting").agg(F.avg("f1_score").alias("mean_f1"))


def knn_search(data: DataFrame, folds: int, ks=(3, 5, 7, 9), weights=("uniform", "distance"),
               metrics=("euclidean", "manhattan")) -> DataFrame:
    """F2 grid: every (k, weights, metric) scored by fold-averaged weighted F1.

    ``data`` has ``id, vec, label, fold``. For each metric one neighbour table of all rows with the largest k
    is computed, in which rows of one fold are no neighbours of each other; every (k, weighting)
    setting is exploded from it and voted in one grouped aggregation, so the
    16 settings cost 2 neighbour searches and one scoring job.
    """
    data = materialize(data)
    kmax = max(ks)
    cands = None
    for metric in metrics:
        c = knn_candidates(data, data, kmax, metric, apart="fold").select(F.lit(metric).alias("metric"), "*")
        cands = c if cands is None else cands.unionByName(c)
    settings = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(w).alias("w"))
                         for k in ks for w in weights])
    x = cands.select("*", F.explode(settings).alias("_st")).where(F.col("nb_rank") <= F.col("_st.k"))
    x = x.withColumn("_least", F.min("dist").over(Window.partitionBy("metric", "test_id")))
    vote = F.when(F.col("_st.w") == "uniform", vote_weight("uniform")).otherwise(vote_weight("distance"))
    setting = F.concat(F.lit("n_neighbors="), F.col("_st.k").cast("string"), F.lit(",weights="),
                       F.col("_st.w"), F.lit(",metric="), F.col("metric"))
    v = x.groupBy(setting.alias("setting"), "test_id", "nb_label").agg(F.sum(vote).alias("v"))
    best = Window.partitionBy("setting", "test_id").orderBy(F.col("v").desc(), F.col("nb_label"))
    pred = v.select("setting", F.col("test_id").alias("id"),
                    F.col("nb_label").alias("prediction"), F.row_number().over(best).alias("_r")) \
        .where("_r = 1").drop("_r")
    labelled = pred.join(data.select("id", "label", "fold"), "id")
    return _f1_by_setting(labelled)


def gnb_search(data: DataFrame, features: Sequence[str], label: str, folds: int,
               smoothings=(1e-9, 1e-8, 1e-7, 1e-6)) -> DataFrame:
    """F4 grid: var_smoothing values scored by fold-averaged weighted F1.

    One aggregate by (fold, class) gives counts, means and squared deviations; a fold's training
    moments are those of the other folds put together. Smoothing only shifts the variances,
    so one more pass scores every row under all settings of its fold's models.
    """
    from loupe.operators.evaluate import metrics_of_counts

    features = list(features)
    data = materialize(data.select(*all_named(features), named(label).alias(label), "fold"))
    x = [as_double(f) for f in features]
    moments = data.groupBy("fold", named(label).alias("label")).agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(x)], *[F.var_pop(c).alias(f"v{i}") for i, c in enumerate(x)]).collect()
    part = {(r["fold"], int(r["label"])): (r["n"], np.array([r[f"m{i}"] for i in range(len(x))], float), np.array([r[f"v{i}"] for i in range(len(x))], float)) for r in moments}
    models = [(f, [(f"var_smoothing={s:g}", _gnb_terms([(c, p) for (g, c), p in part.items() if g != f], s)) for s in smoothings]) for f in sorted({f for f, _ in part})]
    shared = data.sparkSession.sparkContext.broadcast({f: [(name, *map(np.array, zip(*terms))) for name, terms in each] for f, each in models})
    rows = data.select(F.col("fold").cast("int").alias("fold"), named(label).cast("int").alias("label"), F.array(*x).alias("x"))

    def run(batches):
        import pyarrow as pa

        total: dict[tuple, int] = {}
        for b in batches:
            fold, y = b.column("fold").to_numpy(), b.column("label").to_numpy()
            values = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(len(y), -1)
            for f in np.unique(fold):
                for name, cls, start, mean, inv in shared.value[f]:
                    at = np.flatnonzero(fold == f)
                    step = max(1, (1 << 21) // mean.size)
                    for a in range(0, len(at), step):
                        mine = at[a:a + step]
                        says = cls[(start - ((values[mine][:, None] - mean) ** 2 * inv).sum(2)).argmax(1)]  # ties: the smallest class
                        cells, n = np.unique(np.stack([y[mine], says], 1), axis=0, return_counts=True)
                        for (t, p), c in zip(cells.tolist(), n.tolist()):
                            total[name, int(f), t, p] = total.get((name, int(f), t, p), 0) + c
        yield pa.RecordBatch.from_pylist([dict(zip(("setting", "fold", "label", "prediction", "count"), (*k, c))) for k, c in total.items()], pa.schema(
            [("setting", pa.string()), ("fold", pa.int32()), ("label", pa.int32()), ("prediction", pa.int32()), ("count", pa.int64())]))

    counts = rows.mapInArrow(run, "setting string, fold int, label int, prediction int, count bigint")
    counts = counts.groupBy("setting", "fold", "label", "prediction").agg(F.sum("count").alias("count"))
    return metrics_of_counts(counts, ["setting", "fold"]).groupBy("setting").agg(F.avg("f1_score").alias("mean_f1"))


def _gnb_terms(parts: list, smoothing: float) -> list[tuple]:
    """(class, constant, means, 1 / (2 variance)) of the classes of ``parts``: (class, (count, means, variances)) of disjoint rows."""
    def together(some):
        n = sum(p[0] for p in some)
        mean = sum(p[0] * p[1] for p in some) / n
        return n, mean, sum(p[0] * (p[2] + (p[1] - mean) ** 2) for p in some) / n

    total, _, spread = together([p for _, p in parts])
    out = []
    for c in sorted({c for c, _ in parts}):
        n, mean, var = together([p for k, p in parts if k == c])
        var = var + smoothing * float(spread.max())
        out.append((c, math.log(n / total) - 0.5 * float(np.log(2 * math.pi * var).sum()), mean.tolist(), (0.5 / var).tolist()))
    return out


# ---------------------------------------------------------------- F8/F9 grids for MLlib models

# The reference's search grids, in its parameter names.
GRIDS: dict[str, dict[str, list]] = {
    "logistic_regression": {"C": [0.01, 0.1, 1.0, 10.0]},
    "knn": {"n_neighbors": [3, 5, 7, 9], "weights": ["uniform", "distance"], "metric": ["euclidean", "manhattan"]},
    "decision_tree": {"max_depth": [3, 5, 10, None], "min_samples_split": [2, 5, 10], "criterion": ["gini", "entropy"]},
    "naive_bayes": {"var_smoothing": [1e-9, 1e-8, 1e-7, 1e-6]},
    "random_forest": {"n_estimators": [50, 100, 200], "max_depth": [5, 10, None], "min_samples_split": [2, 5], "max_features": ["sqrt", "log2"]},
    "svm": {"C": [0.1, 1.0, 10.0], "kernel": ["linear", "rbf"], "gamma": ["scale", "auto"]},
}
#: Depth that stands for an unlimited one (MLlib's limit).
MAX_DEPTH = 30


def settings_of(name: str, n_draws: int | None = None, seed: int = 42) -> list[dict]:
    """All settings of a model's grid, or ``n_draws`` seeded draws from them."""
    import itertools
    import random

    grid = GRIDS[name]
    every = [dict(zip(grid, v)) for v in itertools.product(*grid.values())]
    if n_draws is not None and len(every) > n_draws:
        every = [every[i] for i in sorted(random.Random(seed).sample(range(len(every)), n_draws))]
    return every


def spark_params(name: str, setting: dict) -> dict:
    """A tree's setting in Spark's parameters: the split minimum becomes half of it per leaf."""
    out: dict = {}
    if "max_depth" in setting:
        out["maxDepth"] = setting["max_depth"] or MAX_DEPTH
    if "min_samples_split" in setting:
        out["minInstancesPerNode"] = max(1, setting["min_samples_split"] // 2)
    if "criterion" in setting:
        out["impurity"] = setting["criterion"]
    if "n_estimators" in setting:
        out["numTrees"] = setting["n_estimators"]
    if "max_features" in setting:
        out["featureSubsetStrategy"] = setting["max_features"]
    return out


def fit_predict(train: DataFrame, test: DataFrame, features: Sequence[str], name: str, label: str, key: str,
                classes: Sequence[int], n_train: int, weight: str | None = None, setting: dict | None = None,
                knn_k: int = 5, shared: Shared | None = None) -> DataFrame:
    """Test rows with ``prediction`` and ``p0 .. p(k-1)`` of one model under one setting; ``shared``: what models of the same rows have in common."""
    setting, k = dict(setting or {}), max(classes) + 1
    if name == "rule_based":
        return predict_majority(test, fit_majority(train, label), k)
    if name == "naive_bayes":
        return by_class(predict_gnb(test, fit_gnb(train, features, label, setting.get("var_smoothing", 1e-9))), classes, k)
    if name == "knn":
        vec = F.array(*[named(f).cast("double") for f in features])
        tr = train.select(named(key).alias("id"), vec.alias("vec"), named(label).cast("long").alias("label"))
        n = setting.get("n_neighbors", knn_k)
        cand = knn_candidates(tr, test.select(named(key).alias("id"), vec.alias("vec")), n, setting.get("metric", "euclidean"))
        votes = knn_vote(cand, n, setting.get("weights", "uniform"), max(2, k))
        return test.join(votes.withColumnRenamed("test_id", key), key)
    if name in ("logistic_regression", "svm"):
        from loupe.operators import linear_path as LP

        c = setting.get("C", 1.0)
        rbf = name == "svm" and setting.get("kernel") == "rbf"
        blocks = shared.blocks() if shared and not rbf else None
        if name == "logistic_regression":
            return LP.predict(test, LP.fit_logistic(train, features, label, k, c, weight, blocks), k)
        rff = rff_params(train, features, setting.get("gamma", "scale")) if rbf else None
        return LP.predict(test, LP.fit_svm(train, features, label, k, c, weight, rff, blocks=blocks), k)
    params = spark_params(name, setting)
    spec_of(name, len(features), **params)  # an unknown name is refused before the rows are read
    return predict_mllib(fit_mllib(train, features, name, label, weight, shared.bins() if shared else None, **params), test, k)


def search_scores(train: DataFrame, features: Sequence[str], name: str, label: str, key: str, folds: int, n_classes: int,
                  weight: str | None = None, n_draws: int | None = None, seed: int = 42) -> list[tuple[dict, float]]:
    """Every searched setting with its mean weighted F1 over stratified folds (:func:`fold_scores`)."""
    from loupe.operators.split import cv_folds

    # written by the tasks that ranked the rows: dealing them to the cores anew would make tasks as large as the input
    train = train.select(*all_named(dict.fromkeys([*features, label, key, *([weight] if weight else [])])))  # ranking writes every column
    data = materialize(cv_folds(train, label, [key], folds, seed, "fold"))
    return fold_scores(data, features, name, label, key, folds, n_classes, settings_of(name, n_draws, seed), weight)


def fold_scores(data: DataFrame, features: Sequence[str], name: str, label: str, key: str | None, folds: int, n_classes: int,
                settings: Sequence[dict], weight: str | None = None) -> list[tuple[dict, float]]:
    """Every setting with its mean weighted F1 over the folds of ``data`` (column ``fold``).

    kNN and naive Bayes settings share their fits, trees and forests are read off nested ensembles
    (:mod:`loupe.operators.forest_path`), linear models of all folds and every C share their passes
    (:mod:`loupe.operators.linear_path`). ``key`` (a long) tells rows apart for kNN.
    """
    from loupe.operators import forest_path, linear_path

    every = list(settings)
    if name == "knn":
        vec = F.array(*[named(f).cast("double") for f in features])
        rows = data.select(named(key).alias("id"), vec.alias("vec"), named(label).cast("long").alias("label"), "fold")
        got = {r["setting"]: r["mean_f1"] for r in knn_search(rows, folds).collect()}
        text = lambda s: f"n_neighbors={s['n_neighbors']},weights={s['weights']},metric={s['metric']}"
    elif name == "naive_bayes":
        got = {r["setting"]: r["mean_f1"] for r in gnb_search(data, features, label, folds).collect()}
        text = lambda s: f"var_smoothing={s['var_smoothing']:g}"
    else:
        text = str
        if name in ("logistic_regression", "svm"):
            scores = linear_path.search(data, features, name, label, folds, n_classes, every, weight)
        else:
            scores = forest_path.search(data, features, name, label, folds, every, weight)
        got = {str(s): sum(v) / len(v) for s, v in zip(every, scores)}
    return [(s, float(got[text(s)])) for s in every]


def search_settings(train: DataFrame, features: Sequence[str], name: str, label: str, key: str, folds: int, n_classes: int,
                    weight: str | None = None, n_draws: int | None = None, seed: int = 42) -> tuple[dict, float]:
    """The setting of :func:`search_scores` with the best mean (ties: the first), and that mean."""
    return max(search_scores(train, features, name, label, key, folds, n_classes, weight, n_draws, seed), key=lambda s: s[1])


def grid_search(data: DataFrame, features: Sequence[str], name: str, folds: int, label: str = "label",
                n_draws: int | None = None, seed: int = 42):
    """Search over the folds of ``data`` (column ``fold``), then the best setting refitted on all rows.

    With ``n_draws`` a seeded sample of the grid is searched (the whole grid when it is smaller). For logistic
    regression, SVM, tree and forest. Returns ``(fitted model, [(setting, mean_f1), ...])``.
    """
    from loupe.operators import linear_path as LP

    if name not in ("logistic_regression", "svm", "decision_tree", "random_forest"):
        raise ValueError(f"no model to refit for {name!r}: use search_settings")
    n_classes = int(data.agg(F.max(named(label))).first()[0]) + 1
    scores = fold_scores(data, features, name, label, None, folds, n_classes, settings_of(name, n_draws, seed))
    best = max(scores, key=lambda s: s[1])[0]
    if name == "logistic_regression":
        return LP.fit_logistic(data, features, label, n_classes, best["C"]), scores
    if name == "svm":
        rff = rff_params(data, features, best["gamma"]) if best["kernel"] == "rbf" else None
        return LP.fit_svm(data, features, label, n_classes, best["C"], rff=rff), scores
    return fit_mllib(data, features, name, label, **spark_params(name, best)), scores
