"""Models on the planted rule, kNN against brute force, CSV round trip, driver contract."""

import os
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from loupe.operators import forest_path as FP
from loupe.operators import linear_path as LP
from loupe.operators import models as M
from loupe.operators import neighbours
from loupe.operators.neighbours import knn_candidates
from loupe.plans.fixtures import planted_lineitem

FEATS = ["l_quantity", "l_discount", "l_tax", "l_extendedprice"]


def _acc(df):
    return df.agg(F.avg((F.col("label") == F.col("prediction")).cast("double"))).collect()[0][0]


def test_tree_beats_majority_on_planted_rule(spark):
    d = planted_lineitem(spark, SF_SMALL)
    train, test = d.where("split = 'train'"), d.where("split = 'test'")
    tree = M.fit_mllib(train, FEATS, "decision_tree", "label")
    assert _acc(M.predict_mllib(tree, test, 2)) >= 0.99
    maj = M.predict_majority(test, M.fit_majority(train, "label"), 2)
    assert _acc(maj) < 0.9
    nb = M.predict_gnb(test, M.fit_gnb(train, FEATS, "label"))
    assert 0.5 < _acc(nb) <= 1.0


def test_knn_matches_brute_force(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 5))
    y = (x[:, 0] > 0).astype(int)
    rows = [(i, [float(v) for v in x[i]], int(y[i])) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, vec array<double>, label long")
    train, test = df.where("id % 4 <> 0"), df.where("id % 4 = 0")
    cand = knn_candidates(train, test, 3, block_rows=50)   # many blocks
    pred = {r["test_id"]: r["prediction"] for r in M.knn_vote(cand, 3).collect()}
    tr = [i for i in range(300) if i % 4]
    for t in range(0, 300, 4):
        d = np.sqrt(((x[tr] - x[t]) ** 2).sum(1))
        order = sorted(range(len(tr)), key=lambda j: (d[j], tr[j]))[:3]
        votes = np.bincount([y[tr[j]] for j in order], minlength=2)
        assert pred[t] == int(np.argmax(votes))


@pytest.mark.parametrize("metric", ["euclidean", "manhattan"])
def test_pivot_index_finds_the_exact_neighbours(spark, metric, monkeypatch):
    """Clusters, ties and copies; inside classes and across folds; far fewer rings visited than there are."""
    monkeypatch.setattr(neighbours, "SMALL_BYTES", 0)
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(size=(900, 2)) * 0.2 + c for c in rng.normal(size=(12, 2)) * 10])[rng.permutation(10_800)[:3000]].round(2)
    x[:200] = x[0]
    ids, grp, fold = rng.permutation(3000), rng.integers(0, 3, 3000), rng.integers(0, 4, 3000)
    df = spark.createDataFrame([(int(i), v.tolist(), int(g), int(f)) for i, v, g, f in zip(ids, x, grp, fold)], "id long, vec array<double>, label long, fold int").repartition(3)

    def brute(t, others, k):
        d = np.abs(x[others] - x[t]).sum(1) if metric == "manhattan" else np.sqrt(((x[others] - x[t]) ** 2).sum(1))
        return [(int(ids[others][j]), float(d[j])) for j in np.lexsort((ids[others], d))[:k]]

    for by, apart, ok in ((None, None, lambda t: np.ones(3000, bool)), ("label", None, lambda t: grp == grp[t]), (None, "fold", lambda t: fold != fold[t])):
        report = {}
        rows = knn_candidates(df, df.where("id % 7 = 0"), 5, metric, block_rows=64, by=by, apart=apart, report=report).orderBy("test_id", "nb_rank").collect()
        got = {}
        for r in rows:
            got.setdefault(r.test_id, []).append((r.train_id, r.dist))
        want = {int(ids[t]): brute(t, np.flatnonzero(ok(t)), 5) for t in range(3000) if ids[t] % 7 == 0}
        assert got == want
        assert report["visits"] < 0.4 * report["rings"] * report["tests"]
    assert knn_candidates(df, df.where("id % 7 = 0"), 5, metric, by="label", apart="fold").count() > 0
    monkeypatch.setattr(neighbours, "SMALL_BYTES", 1 << 30)  # the same rows without an index
    for by, apart, ok in ((None, None, lambda t: np.ones(3000, bool)), ("label", "fold", lambda t: (grp == grp[t]) & (fold != fold[t]))):
        got = {}
        for r in knn_candidates(df, df.where("id % 7 = 0"), 5, metric, by=by, apart=apart).orderBy("test_id", "nb_rank").collect():
            got.setdefault(r.test_id, []).append((r.train_id, r.dist))
            assert r.nb_rank == len(got[r.test_id])
        assert got == {int(ids[t]): brute(t, np.flatnonzero(ok(t)), 5) for t in range(3000) if ids[t] % 7 == 0}
    few = df.where("id < 3")
    assert knn_candidates(few, df.where("id < 9"), 5, metric).count() == 27 and knn_candidates(df.limit(0), few, 5).count() == 0


@pytest.mark.parametrize("metric", ["euclidean", "manhattan"])
def test_neighbours_in_many_dimensions_by_shelves(spark, metric, monkeypatch):
    """Rows without structure, ties, copies, nulls and far outliers; a row's vector is sent once per shelf, not once per ring."""
    monkeypatch.setattr(neighbours, "SMALL_BYTES", 0)
    monkeypatch.setattr(neighbours, "TILE", 40)
    sent = []
    searched = neighbours._searched
    monkeypatch.setattr(neighbours, "_searched", lambda visits, *rest: sent.append(visits.count()) or searched(visits, *rest))
    rng = np.random.default_rng(3)
    x = rng.normal(size=(900, 14)).round(1)
    x[:60], x[60:80] = x[0], rng.integers(0, 2, (20, 14))
    x[80:83] *= 1e12
    ids, grp, fold = rng.permutation(900), rng.integers(0, 2, 900), rng.integers(0, 3, 900)
    odd = [(2000, None, 0, 0), (2001, [float("nan")] * 14, 1, 1), (2002, [float("inf")] * 14, 1, 1)]
    df = spark.createDataFrame([*[(int(i), v.tolist(), int(g), int(f)) for i, v, g, f in zip(ids, x, grp, fold)], *odd], "id long, vec array<double>, label long, fold int").repartition(3)
    for by, apart, ok in ((None, None, lambda t: np.ones(900, bool)), ("label", None, lambda t: grp == grp[t]), (None, "fold", lambda t: fold != fold[t])):
        sent.clear()
        report, got, want = {}, {}, {}
        for r in knn_candidates(df, df.where("id % 2 = 0"), 5, metric, block_rows=8, by=by, apart=apart, report=report).orderBy("test_id", "nb_rank").collect():
            got.setdefault(r.test_id, []).append((r.train_id, r.dist))
        for t in np.flatnonzero(ids % 2 == 0):
            others = np.flatnonzero(ok(t))
            d = np.abs(x[others] - x[t]).sum(1) if metric == "manhattan" else np.sqrt(((x[others] - x[t]) ** 2).sum(1))
            want[int(ids[t])] = [(int(ids[others][j]), float(d[j])) for j in np.lexsort((ids[others], d))[:5]]
        assert got == want
        assert report["tests"] == 450 and sum(sent) < 0.5 * report["visits"]


def test_csv_round_trip_with_missing_tokens(spark):
    from loupe.sources.csv import read_csv, write_results
    d = tempfile.mkdtemp(prefix="loupe-csv-")
    p = os.path.join(d, "in.csv")
    with open(p, "w") as f:
        f.write("a,b,c,d\n1,x,2024-01-02,true\nNA,None,,false\n3,y,2024-02-03,true\n")
    df = read_csv(spark, p)
    types = dict(df.dtypes)
    assert types["a"] == "bigint" and types["b"] == "string" and types["d"] == "boolean"
    assert types["c"].startswith("timestamp")
    assert df.where(F.col("a").isNull() & F.col("b").isNull() & F.col("c").isNull()).count() == 1
    out = os.path.join(d, "out")
    write_results(df.select("a", "b"), out)
    text = "".join(open(os.path.join(out, f)).read() for f in os.listdir(out) if f.endswith(".csv"))
    assert "N/A" in text


def test_entry_and_registry(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert set(df.columns) == {"issue", "column_name", "detail", "metric", "value"}
    assert df.count() > 0
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 80


def test_smote_balances_and_stays_on_segments(spark):
    from loupe.operators.balance import smote
    rng = np.random.default_rng(2)
    n = 400
    x = rng.normal(size=(n, 2))
    y = (rng.random(n) < 0.2).astype(int)
    rows = [(i, float(x[i, 0]), float(x[i, 1]), int(y[i])) for i in range(n)]
    df = spark.createDataFrame(rows, "id long, a double, b double, label int")
    out = smote(df, ["a", "b"], "label", "id", k=3).toPandas()
    counts = out.groupby("label").size()
    assert counts[0] == counts[1] == (y == 0).sum()
    syn = out[out.synthetic]
    assert (syn.label == 1).all()
    mins = x[y == 1]
    # every synthetic point lies inside the bounding box of the minority class
    assert (syn.a >= mins[:, 0].min() - 1e-12).all() and (syn.a <= mins[:, 0].max() + 1e-12).all()


def test_fitted_params_apply_to_a_stream(spark):
    from loupe.operators import prep as P
    from loupe.streaming import apply_fitted
    df = spark.createDataFrame([(1.0, "a"), (None, "b"), (3.0, None), (5.0, "a")], "x double, c string")
    params = {"impute": {**P.fit_numeric_imputer(df, ["x"], "median"),
                         **P.fit_categorical_imputer(df, ["c"])}}
    d = tempfile.mkdtemp(prefix="loupe-stream-")
    df.write.mode("overwrite").parquet(os.path.join(d, "in"))
    stream = spark.readStream.schema(df.schema).parquet(os.path.join(d, "in"))
    q = (apply_fitted(stream, params).writeStream.format("memory").queryName("loupe_stream_test")
         .option("checkpointLocation", os.path.join(d, "ckpt")).start())
    q.processAllAvailable()
    q.stop()
    got = sorted((r["x"], r["c"]) for r in spark.sql("SELECT * FROM loupe_stream_test").collect())
    assert got == [(1.0, "a"), (3.0, "a"), (3.0, "b"), (5.0, "a")]


def test_three_class_status_covers_all_seven_models(spark):
    from loupe.plans.catalog import queries
    from loupe.plans.workflow import MODEL_NAMES
    rows = queries()["q_train_status_more"](spark, SF_SMALL).collect()
    assert {r.model for r in rows} == {"knn", "random_forest", "svm", "rule_based"}
    assert {r.model for r in rows} | {"logistic_regression", "decision_tree", "naive_bayes"} == set(MODEL_NAMES)
    assert all(r.status == "ok" and r.n_classes == 3 for r in rows) and len({r.n_rows for r in rows}) == 1
    assert all(r.beats_majority for r in rows if r.model != "rule_based")


def test_full_grids_have_queries_and_scores_for_every_setting(spark):
    from loupe.plans.catalog import queries
    assert {"q_forest_search", "q_svm_search"} <= set(queries())
    assert len(M.settings_of("random_forest")) == 36 and len(M.settings_of("svm")) == 12
    rows = [(i, float(i % 7), float(i % 5), int(i % 7 > 3)) for i in range(210)]
    df = spark.createDataFrame(rows, "rid bigint, x double, `y.z` double, label int").coalesce(1)
    got = M.search_scores(df, ["x", "y.z"], "svm", "label", "rid", 2, 2)
    assert [s for s, _ in got] == M.settings_of("svm") and all(0.9 < f <= 1 for s, f in got if s["C"] > 1)
    model, scores = M.grid_search(df.withColumn("fold", F.col("rid") % 3), ["x", "y.z"], "svm", 3)
    assert len(scores) == 12 and _acc(LP.predict(df, model, 2)) > 0.95
    tree, scores = M.grid_search(df.withColumn("fold", F.col("rid") % 3), ["x", "y.z"], "decision_tree", 3, n_draws=5)
    assert len(scores) == 5 and _acc(M.predict_mllib(tree, df, 2)) == 1


@pytest.mark.parametrize("name", ["random_forest", "decision_tree"])
def test_nested_ensembles_predict_like_models_of_their_own(spark, name):
    """Cut off at its own depth and size an ensemble predicts as MLlib says; a shallower one as one fitted so deep (trees: exactly)."""
    rng = np.random.default_rng(4)
    x = np.round(rng.random((1500, 3)), 2)
    y = ((x[:, 0] > 0.4) & (x[:, 1] > 0.3)).astype(int) + (x[:, 2] > 0.7)
    df = spark.createDataFrame([(*map(float, a), int(b)) for a, b in zip(x, y)], "a double, b double, c double, label int").coalesce(1)
    f = ["a", "b", "c"]
    more = {"numTrees": 20} if name == "random_forest" else {}
    fit = lambda depth: M.fit_mllib(df, f, name, "label", maxDepth=depth, **more)
    nodes = FP.nodes_of(fit(9).model, spark)
    says = {(d, n): p for d, n, p in FP.votes(nodes, x, [2, 9], [5, 20])}
    own = lambda m: np.array([r.prediction for r in M.predict_mllib(m, df, 3).collect()])
    assert (says[9, 20] == own(fit(9))).all()
    if name == "decision_tree":
        assert (says[2, 20] == own(fit(2))).all()
    held = df.select(F.array(*f).alias("x"), "label")
    counts = FP.confusion_by_setting(held, nodes, [2, 9], [5, 20]).collect()
    assert sum(r["count"] for r in counts) == 4 * len(x)
    assert sum(r["count"] for r in counts if (r.depth, r.trees) == (2, 5) and r.label == r.prediction) == (says[2, 5] == y).sum()


def test_linear_paths_reach_the_optimum(spark):
    """Gradients vanish at every fold and C, and equal numeric ones; probabilities are the objective's own."""
    rng = np.random.default_rng(6)
    n = 400
    x = np.stack([rng.normal(5, 2, n), rng.normal(0, 100, n)], 1)
    y = (x[:, 0] * 0.7 + x[:, 1] * 0.01 + rng.normal(0, 1, n) > 3.5).astype(int)
    df = spark.createDataFrame([(float(a), float(b), int(c), i % 3) for i, ((a, b), c) in enumerate(zip(x, y))], "`a b` double, `c.d` double, label int, fold int")
    f = ["a b", "c.d"]
    path = LP.fit_path(LP.blocks_of(df, f, "label", 2, F.col("fold")), "logistic", [(k, c) for k in (-1, 0, 2) for c in (0.1, 10.0)], tol=1e-6)
    assert path.passes < 100
    for i, (k, c) in enumerate(zip(path.left_out, path.c)):
        m = LP.model_of(path, i)
        rows = np.arange(n) % 3 != k
        z = x[rows] @ m.weights[:, 0] + m.intercepts[0]
        p = 1 / (1 + np.exp(-z))
        grad = np.r_[c * x[rows].T @ (p - y[rows]) + m.weights[:, 0], c * (p - y[rows]).sum()]
        assert (np.abs(grad) < 1e-2 * c * np.r_[2, 100, 1]).all()
    got = LP.predict(df, LP.model_of(path, 1), 2)
    assert got.columns == [*df.columns, "prediction", "p0", "p1", "score"] and _acc(got) > 0.75
    svm = LP.fit_svm(df, f, "label", 2)
    r = LP.predict(df, svm, 2).agg(F.avg(F.when(F.col("label") == 1, F.col("p1"))), F.avg(F.when(F.col("label") == 0, F.col("p1")))).first()
    assert r[0] > 0.7 and r[1] < 0.4
    three = df.withColumn("label", (F.col("`a b`") > 4).cast("int") + (F.col("`a b`") > 6).cast("int"))
    assert _acc(LP.predict(three, LP.fit_logistic(three, f, "label", 3, 100.0), 3)) > 0.85
    assert _acc(LP.predict(three, LP.fit_svm(three, f, "label", 3, 100.0), 3)) > 0.6


@pytest.mark.parametrize("rff", [None, "scale"])
def test_large_linear_fits_begin_near_the_optimum(spark, rff, monkeypatch):
    """A fit on some of the rows comes first; the one over all rows stops by the same rule, after far fewer passes."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(6000, 3))
    df = spark.createDataFrame([(*map(float, v), int(v[0] * v[1] + v[2] > 0), i % 3, 1.0 + i % 2) for i, v in enumerate(x)], "a double, b double, c double, label int, fold int, w double").repartition(3)
    f = ["a", "b", "c"]
    fourier = M.rff_params(df, f, rff, 20, 1) if rff else None
    settings = [(-1, 1.0), (0, 1.0), (1, 0.1)]
    for weight, kind in ((None, "hinge"), ("w", "logistic")):
        monkeypatch.setattr(LP, "WARM_ROWS", 1 << 21)
        cold = LP.blocks_of(df, f, "label", 2, F.col("fold"), weight, fourier)
        one = LP.fit_path(cold, kind, settings, tol=1e-3)
        monkeypatch.setattr(LP, "WARM_ROWS", 1500)
        warm = LP.blocks_of(df, f, "label", 2, F.col("fold"), weight, fourier)
        two = LP.fit_path(warm, kind, settings, tol=1e-3)
        assert cold.some is None and warm.some.agg(F.sum("n")).first()[0] in range(1490, 1511) and warm.rows.agg(F.sum("n")).first()[0] == 6000
        assert two.passes < one.passes and two.slope.max() < 5e-3
        assert np.abs(LP.fit_sigmoid(one)[0] - LP.fit_sigmoid(two)[0]) < 0.2
        said = [{(r.model, r.label, r.prediction): r["count"] for r in LP.held_out_confusion(p).collect()} for p in (one, two)]
        assert all(abs(said[0].get(c, 0) - said[1].get(c, 0)) < 60 for c in said[0])
        cold.close()
        warm.close()
