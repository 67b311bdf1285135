"""Evaluation of predictions.

Input is a predictions table: group columns (model, segment, ...), ``label``,
``prediction`` and, for curves, a positive-class ``score`` or per-class
probability columns. Every metric is an aggregation over that table:
confusion counts first (one shuffle, map-side combined), then tiny per-class
tables. AUC and ROC use :func:`loupe.functions.ranks.cumulative`, so no
window ever holds all distinct scores of a model in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loupe.functions.names import all_named, named
from loupe.session import attach_row, join_small, materialize


def _g(group: Sequence[str] | None) -> list[str]:
    return list(group or [])


def confusion_counts(preds: DataFrame, group=None, label: str = "label",
                     prediction: str = "prediction") -> DataFrame:
    """``group..., label, prediction, count`` for the cells that occur."""
    return preds.groupBy(*_g(group), named(label).alias("label"),
                         named(prediction).alias("prediction")) \
        .agg(F.count(F.lit(1)).alias("count"))


def per_class(cm: DataFrame, group=None) -> DataFrame:
    """Per class of the sorted union of true and predicted labels: tp, fp, fn, tn, support."""
    g = _g(group)
    true_c = cm.groupBy(*all_named(g), F.col("label").alias("cls")).agg(F.sum("count").alias("support"))
    pred_c = cm.groupBy(*all_named(g), F.col("prediction").alias("cls")).agg(F.sum("count").alias("predicted"))
    tp = cm.where(F.col("label") == F.col("prediction")) \
        .select(*all_named(g), F.col("label").alias("cls"), F.col("count").alias("tp"))
    k = true_c.join(pred_c, [*g, "cls"], "full").join(tp, [*g, "cls"], "left")
    total = F.sum("support").over(Window.partitionBy(*all_named(g)))
    k = k.select(*all_named(g), "cls", F.coalesce("tp", F.lit(0)).alias("tp"),
                 F.coalesce("support", F.lit(0)).alias("support"),
                 F.coalesce("predicted", F.lit(0)).alias("predicted"))
    k = k.select("*", F.coalesce(total, F.lit(0)).alias("n"))
    prec = F.coalesce(F.try_divide(F.col("tp"), F.col("predicted")), F.lit(0.0))
    rec = F.coalesce(F.try_divide(F.col("tp"), F.col("support")), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * prec * rec, prec + rec), F.lit(0.0))
    return k.select(*all_named(g), "cls", "tp", (F.col("predicted") - F.col("tp")).alias("fp"),
                    (F.col("support") - F.col("tp")).alias("fn"),
                    (F.col("n") - F.col("support") - F.col("predicted") + F.col("tp")).alias("tn"),
                    prec.cast("double").alias("precision"), rec.cast("double").alias("recall"),
                    f1.cast("double").alias("f1_score"), "support")


def basic_metrics(preds: DataFrame, group=None) -> DataFrame:
    """Accuracy and support-weighted precision, recall, F1 (0/0 -> 0)."""
    return metrics_of_counts(confusion_counts(preds, _g(group)), group)


def metrics_of_counts(counts: DataFrame, group=None) -> DataFrame:
    """G1/G2 from ``group..., label, prediction, count``."""
    g = _g(group)
    return per_class(counts, g).groupBy(*all_named(g)).agg(
        (F.sum("tp") / F.sum("support")).alias("accuracy"),
        (F.sum(F.col("precision") * F.col("support")) / F.sum("support")).alias("precision"),
        (F.sum(F.col("recall") * F.col("support")) / F.sum("support")).alias("recall"),
        (F.sum(F.col("f1_score") * F.col("support")) / F.sum("support")).alias("f1_score"))


def confusion_matrix(preds: DataFrame, group=None) -> DataFrame:
    """Full grid over the sorted union of labels, zeros included.

    The class list of a group (a handful of labels) is gathered into one
    array and exploded twice, so the grid needs no join of large inputs.
    """
    g = _g(group)
    cm = confusion_counts(preds, g)
    cls = (cm.select(*all_named(g), F.col("label").alias("c"))
           .unionByName(cm.select(*all_named(g), F.col("prediction").alias("c")))
           .groupBy(*all_named(g)).agg(F.array_sort(F.collect_set("c")).alias("_cl")))
    grid = cls.select(*all_named(g), F.explode("_cl").alias("label"), "_cl") \
        .select(*all_named(g), "label", F.explode("_cl").alias("prediction"))
    out = grid.join(cm, [*g, "label", "prediction"], "left")
    return out.select(*all_named(g), "label", "prediction", F.coalesce("count", F.lit(0)).alias("count"))


def confusion_normalized(preds: DataFrame, group=None) -> DataFrame:
    """Rows normalised by the true-class total; an empty true class gives NULL."""
    g = _g(group)
    cm = confusion_matrix(preds, g)
    row = F.sum("count").over(Window.partitionBy(*all_named(g), "label"))
    return cm.select(*all_named(g), "label", "prediction", "count",
                     F.try_divide(F.col("count").cast("double"), F.when(row > 0, row)).alias("rate"))


def class_metrics(preds: DataFrame, group=None) -> DataFrame:
    """Per class TP/FP/FN/TN, precision, recall, F1, support."""
    return per_class(confusion_counts(preds, _g(group)), _g(group))


def mcc(preds: DataFrame, group=None) -> DataFrame:
    """Multiclass Matthews correlation; a zero denominator gives 0."""
    return mcc_of_counts(confusion_counts(preds, _g(group)), group)


def mcc_of_counts(counts: DataFrame, group=None) -> DataFrame:
    """G6 from ``group..., label, prediction, count``."""
    g = _g(group)
    pc = per_class(counts, g)
    n = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    a = pc.groupBy(*all_named(g)).agg(F.sum("tp").cast("double").alias("c"), F.max(n).cast("double").alias("s"),
                           F.sum((F.col("tp") + F.col("fp")).cast("double") * F.col("support"))
                           .alias("pt"),
                           F.sum(F.pow((F.col("tp") + F.col("fp")).cast("double"), 2)).alias("pp"),
                           F.sum(F.pow(F.col("support").cast("double"), 2)).alias("tt"))
    num = F.col("c") * F.col("s") - F.col("pt")
    den = F.sqrt((F.col("s") * F.col("s") - F.col("pp")) * (F.col("s") * F.col("s") - F.col("tt")))
    return a.select(*all_named(g), F.coalesce(F.try_divide(num, F.when(den > 0, den)), F.lit(0.0)).alias("mcc"))


# ---------------------------------------------------------------- curves

def _score_counts(df: DataFrame, keys: list[str], y: str, score: str) -> DataFrame:
    return df.select(*all_named(keys), named(y).cast("int").alias("_y"), named(score).cast("double").alias("score"))


def _cum(df: DataFrame, keys: list[str]) -> DataFrame:
    from loupe.functions.ranks import cumulative
    return cumulative(df, keys, "score", {
        "pos": F.sum((F.col("_y") == 1).cast("long")),
        "neg": F.sum((F.col("_y") != 1).cast("long"))})


def auc(df: DataFrame, keys=None, y: str = "label", score: str = "score") -> DataFrame:
    """Rank-based ROC AUC (exact under ties) per key; NULL without both classes."""
    k = _g(keys)
    runs = _runs(_score_counts(df, k, y, score), k)
    before = Window.partitionBy("_k").orderBy("_s", "_r").rowsBetween(Window.unboundedPreceding, -1)
    below = F.coalesce(F.sum("neg").over(before), F.lit(0))
    a = runs.select("*", (F.col("area") + F.col("pos") * below).alias("_a")).groupBy(*all_named(k)).agg(
        F.sum("_a").alias("_s"), F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))
    return _share_of_pairs(a, k)


def _runs(d: DataFrame, keys: list[str]) -> DataFrame:
    """``keys..., _k, _s, _r, pos, neg, area`` of the runs of one key in the batches of its sorted score counts.

    ``area``: the pairs of the run in which the positive row is above (half of those that tie). Runs of a key
    are in the order of their scores by slice ``_s`` and number ``_r``: a few rows for each slice and
    key, where a window over all scores would sort and shuffle them once more.
    """
    cond = named("score").isNotNull()
    for c in keys:
        cond = cond & named(c).isNotNull()
    one = F.col("_y") == 1
    g = d.where(cond).groupBy(*all_named(keys), "score").agg(F.sum(one.cast("long")).alias("pos"), F.sum((F.col("_y") != 1).cast("long")).alias("neg"))
    by = [*all_named(keys), F.col("score")]
    plain = [f"_k{i}" for i in range(len(keys))]  # mapInArrow takes no dots in names
    ranged = g.repartitionByRange(*by).withColumn("_s", F.spark_partition_id()).sortWithinPartitions(*by)
    ranged = ranged.select(*[named(c).alias(n) for c, n in zip(keys, plain)], "score", "pos", "neg", "_s")

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        number = 0
        for b in batches:
            if not b.num_rows:
                continue
            new = np.r_[True, np.zeros(b.num_rows - 1, bool)]
            for i in range(len(keys)):
                new[1:] |= pc.not_equal(b.column(i).slice(1), b.column(i).slice(0, b.num_rows - 1)).to_numpy(zero_copy_only=False)
            at = np.flatnonzero(new)
            pos, neg = (b.column(c).fill_null(0).to_numpy() for c in ("pos", "neg"))
            below = np.cumsum(neg) - neg
            below = below - np.repeat(below[at], np.diff(np.r_[at, len(pos)]))
            area = np.add.reduceat(pos * (below + 0.5 * neg), at)
            first = pa.array(at)
            yield pa.RecordBatch.from_arrays(
                [*[b.column(i).take(first) for i in range(len(keys))], b.column("_s").take(first), pa.array(number + np.arange(len(at))), pa.array(np.add.reduceat(pos, at)), pa.array(np.add.reduceat(neg, at)), pa.array(area)],
                [*plain, "_s", "_r", "pos", "neg", "area"])
            number += len(at)

    schema = T.StructType([*[T.StructField(n, g.schema[c].dataType) for c, n in zip(keys, plain)], *[T.StructField(c, t) for c, t in (("_s", T.IntegerType()), ("_r", T.LongType()), ("pos", T.LongType()), ("neg", T.LongType()), ("area", T.DoubleType()))]])
    key = F.struct(*plain) if keys else F.struct(F.lit(0).alias("all"))
    return ranged.mapInArrow(run, schema).select(*[F.col(n).alias(c) for c, n in zip(keys, plain)], key.alias("_k"), "_s", "_r", "pos", "neg", "area")


def _auc_of(c: DataFrame, k: list[str]) -> DataFrame:
    part = F.col("pos") * (F.col("neg_before") + 0.5 * F.col("neg"))
    a = c.groupBy(*all_named(k)).agg(F.sum(part).alias("_s"), F.max("pos_total").alias("_p"),
                          F.max("neg_total").alias("_n"))
    return _share_of_pairs(a, k)


def _share_of_pairs(a: DataFrame, k: list[str]) -> DataFrame:
    return a.select(*all_named(k), F.try_divide(F.col("_s"), F.when((F.col("_p") > 0) & (F.col("_n") > 0),
                                                         F.col("_p") * F.col("_n"))).alias("auc"))


def roc_points(df: DataFrame, keys=None, y: str = "label", score: str = "score") -> DataFrame:
    """``fpr, tpr`` at every distinct threshold (descending), plus the origin.

    Points are kept (no thinning of collinear points); the origin has a NULL
    threshold.
    """
    k = _g(keys)
    return _points_of(_cum(_score_counts(df, k, y, score), k), k)


def points_and_auc(df: DataFrame, keys=None, y: str = "label", score: str = "score") -> DataFrame:
    """:func:`roc_points` with each key's AUC on every point, from one cumulation."""
    k = _g(keys)
    c = materialize(_cum(_score_counts(df, k, y, score), k))
    pts, a = _points_of(c, k), _auc_of(c, k)
    if not k:
        return join_small(pts.withColumn("_k", F.lit(1)), a.withColumn("_k", F.lit(1)), ["_k"]).drop("_k")
    return join_small(pts, a, k)


def _points_of(c: DataFrame, k: list[str]) -> DataFrame:
    tp = F.col("pos_total") - F.col("pos_before")
    fp = F.col("neg_total") - F.col("neg_before")
    pts = c.select(*all_named(k), F.col("score").alias("threshold"),
                   F.try_divide(fp.cast("double"), F.when(F.col("neg_total") > 0, F.col("neg_total")))
                   .alias("fpr"),
                   F.try_divide(tp.cast("double"), F.when(F.col("pos_total") > 0, F.col("pos_total")))
                   .alias("tpr"))
    origin = c.groupBy(*all_named(k)).agg(F.lit(None).cast("double").alias("threshold"),
                               F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return pts.unionByName(origin)


def one_vs_rest(df: DataFrame, prob_cols: Sequence[str], label: str = "label", group=None) -> DataFrame:
    """Tall ``group..., cls, y, score`` with one row per (row, class)."""
    g = _g(group)
    items = F.array(*[F.struct(F.lit(i).alias("cls"), named(p).cast("double").alias("score"))
                      for i, p in enumerate(prob_cols)])
    t = df.select(*all_named(g), label, F.explode(items).alias("_c"))
    return t.select(*all_named(g), "_c.cls", (named(label) == F.col("_c.cls")).cast("int").alias("y"),
                    "_c.score")


def auc_ovr_macro(df: DataFrame, prob_cols: Sequence[str], label: str = "label", group=None) -> DataFrame:
    """Mean of one-vs-rest AUCs over the classes present in the labels."""
    g = _g(group)
    present = df.select(*all_named(g), named(label).alias("cls")).distinct()
    per = auc(one_vs_rest(df, prob_cols, label, g), [*g, "cls"], "y", "score")
    return per.join(present, [*g, "cls"]).groupBy(*all_named(g)).agg(F.avg("auc").alias("auc_macro"))


def roc_ovr(df: DataFrame, prob_cols: Sequence[str], label: str = "label", group=None) -> DataFrame:
    """Per class ROC points and AUC."""
    g = _g(group)
    return points_and_auc(one_vs_rest(df, prob_cols, label, g), [*g, "cls"], "y", "score")


def roc_micro(df: DataFrame, prob_cols: Sequence[str], label: str = "label", group=None) -> DataFrame:
    """Micro-average — all (row, class) cells pooled into one binary problem."""
    g = _g(group)
    return points_and_auc(one_vs_rest(df, prob_cols, label, g), g, "y", "score")


def roc_macro(df: DataFrame, prob_cols: Sequence[str], label: str = "label") -> DataFrame:
    """Macro-average ROC — each class TPR interpolated on the union of FPRs and averaged.

    Interpolation is an as-of lookup of the previous and next curve point
    (:func:`loupe.functions.ranks.fill_last` both ways), so no class curve is
    walked in one task. Where a curve is vertical the last point at that FPR
    is used (as ``numpy.interp`` does). ``auc_macro`` is the trapezoid area of
    the averaged curve (close to, not always equal to, the mean OvR AUC).
    """
    from loupe.functions.ranks import fill_last

    t = one_vs_rest(df, prob_cols, label)
    pts = roc_points(t, ["cls"], "y", "score").select("cls", "fpr", "tpr")
    k = len(prob_cols)
    grid = pts.select("fpr").distinct()
    classes = F.array(*[F.lit(i) for i in range(k)])
    g = grid.select("fpr", F.explode(classes).alias("cls"), F.lit(None).cast("double").alias("tpr"),
                    F.lit(1).alias("_grid"))
    both = pts.select("cls", "fpr", "tpr", F.lit(0).alias("_grid")).unionByName(g)
    both = both.select("*", F.struct("fpr", "_grid", "tpr").alias("_o"),
                       F.when(F.col("_grid") == 0, F.struct("fpr", "tpr")).alias("_pt"))
    # the as-of fills below sample and scan this table several times: cut the
    # lineage once (reliable checkpoint in spark.checkpoint.dir)
    from loupe.session import cut_lineage
    both = cut_lineage(both)
    prev = fill_last(both, ["cls"], "_o", "_pt", "_lo")
    nxt = fill_last(prev, ["cls"], "_o", "_pt", "_hi", descending=True)
    x0, y0, x1, y1 = (F.col("_lo.fpr"), F.col("_lo.tpr"), F.col("_hi.fpr"), F.col("_hi.tpr"))
    interp = F.when(F.col("_hi").isNull(), y0).when(x1 == x0, y0) \
        .otherwise(y0 + (y1 - y0) * (F.col("fpr") - x0) / (x1 - x0))
    gi = nxt.where(F.col("_grid") == 1).select("cls", "fpr", interp.alias("tpr_i"))
    mean = cut_lineage(gi.groupBy("fpr").agg(F.avg("tpr_i").alias("tpr")))
    # trapezoid over the averaged curve: each grid point meets its predecessor
    # through the same as-of fill (query rows sort just before the points)
    pts_m = mean.select(F.lit(0).alias("_g"), "fpr", "tpr",
                        F.struct("fpr", F.lit(1).alias("b")).alias("_o"),
                        F.struct("fpr", "tpr").alias("_pt"))
    qry = mean.select(F.lit(0).alias("_g"), "fpr", "tpr",
                      F.struct("fpr", F.lit(0).alias("b")).alias("_o"),
                      F.lit(None).cast("struct<fpr:double,tpr:double>").alias("_pt"))
    f = fill_last(pts_m.unionByName(qry), ["_g"], "_o", "_pt", "_prev")
    seg = (F.col("fpr") - F.col("_prev.fpr")) * (F.col("tpr") + F.col("_prev.tpr")) / 2
    area = f.where(F.col("_pt").isNull()).agg(F.coalesce(F.sum(seg), F.lit(0.0)).alias("auc_macro"))
    return attach_row(mean, area)


def roc_ovo(df: DataFrame, prob_cols: Sequence[str], label: str = "label") -> DataFrame:
    """Per class pair i<j, AUC of class j against i on ``p_j / (p_i + p_j)``."""
    return auc(_one_vs_one(df, prob_cols, label), ["class_i", "class_j"], "y", "score")


def roc_ovo_points(df: DataFrame, prob_cols: Sequence[str], label: str = "label") -> DataFrame:
    """The curve of each class pair."""
    return roc_points(_one_vs_one(df, prob_cols, label), ["class_i", "class_j"], "y", "score")


def _one_vs_one(df: DataFrame, prob_cols: Sequence[str], label: str) -> DataFrame:
    """``class_i, class_j, y, score`` of the rows of either class of each pair.

    Each row joins the k-1 pairs its label belongs to (an explode, bounded
    by the class count). Rows with ``p_i + p_j = 0`` are dropped.
    """
    k = len(prob_cols)
    pairs = [(i, j) for i in range(k) for j in range(i + 1, k)]
    items = F.array(*[F.struct(F.lit(i).alias("ci"), F.lit(j).alias("cj"),
                               F.col(prob_cols[i]).cast("double").alias("pi"),
                               F.col(prob_cols[j]).cast("double").alias("pj")) for i, j in pairs])
    t = df.select(named(label), F.explode(items).alias("_p")).select(named(label), "_p.*")
    t = t.where(named(label).isin(F.col("ci"), F.col("cj")))
    t = t.select(F.col("ci").alias("class_i"), F.col("cj").alias("class_j"),
                 (named(label) == F.col("cj")).cast("int").alias("y"),
                 F.try_divide(F.col("pj"), F.when(F.col("pi") + F.col("pj") != 0,
                                                  F.col("pi") + F.col("pj"))).alias("score"))
    return t.where(F.col("score").isNotNull())


def auc_pair_matrix(ovo: DataFrame) -> DataFrame:
    """Symmetric pair matrix with the mean pairwise AUC and pair count on every row."""
    sym = ovo.select(F.col("class_i").alias("class_a"), F.col("class_j").alias("class_b"), "auc") \
        .unionByName(ovo.select(F.col("class_j").alias("class_a"), F.col("class_i").alias("class_b"),
                                "auc"))
    allp = Window.partitionBy()
    return sym.select("class_a", "class_b", "auc",
                      (F.sum("auc").over(allp) / F.count("auc").over(allp)).alias("mean_auc"),
                      (F.count("auc").over(allp) / 2).cast("long").alias("n_pairs"))


def classification_report(preds: DataFrame, group=None) -> DataFrame:
    """Per class precision/recall/F1/support, plus accuracy, macro and weighted averages."""
    g = _g(group)
    pc = class_metrics(preds, g)
    rows = pc.select(*all_named(g), F.col("cls").cast("string").alias("item"), "precision", "recall",
                     "f1_score", "support")
    agg = pc.groupBy(*all_named(g)).agg(
        F.avg("precision").alias("mp"), F.avg("recall").alias("mr"), F.avg("f1_score").alias("mf"),
        (F.sum(F.col("precision") * F.col("support")) / F.sum("support")).alias("wp"),
        (F.sum(F.col("recall") * F.col("support")) / F.sum("support")).alias("wr"),
        (F.sum(F.col("f1_score") * F.col("support")) / F.sum("support")).alias("wf"),
        (F.sum("tp") / F.sum("support")).alias("acc"), F.sum("support").alias("n"))
    macro = agg.select(*all_named(g), F.lit("macro avg").alias("item"), F.col("mp").alias("precision"),
                       F.col("mr").alias("recall"), F.col("mf").alias("f1_score"),
                       F.col("n").alias("support"))
    weighted = agg.select(*all_named(g), F.lit("weighted avg").alias("item"), F.col("wp").alias("precision"),
                          F.col("wr").alias("recall"), F.col("wf").alias("f1_score"),
                          F.col("n").alias("support"))
    accuracy = agg.select(*all_named(g), F.lit("accuracy").alias("item"),
                          F.lit(None).cast("double").alias("precision"),
                          F.lit(None).cast("double").alias("recall"),
                          F.col("acc").alias("f1_score"), F.col("n").alias("support"))
    return rows.unionByName(macro).unionByName(weighted).unionByName(accuracy)
