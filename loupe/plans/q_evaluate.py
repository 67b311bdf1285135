"""Evaluation queries (G1-G18) over hash-made prediction views of events and embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from loupe.operators import evaluate as G
from loupe.operators import ranking as R
from loupe.plans.catalog import register
from loupe.plans.fixtures import preds_binary, preds_multi

PROBS = ["p0", "p1", "p2"]
# Training seconds per hash-made model (the timing input of the ranking).
MODEL_SECONDS = {"m1": 2.5, "m2": 0.5}


@register("q_eval_basic")
def q_eval_basic(spark, sf):
    """Accuracy and weighted precision/recall/F1 per model."""
    return G.basic_metrics(preds_binary(spark, sf), ["model"])


@register("q_confusion")
def q_confusion(spark, sf):
    """3-class confusion matrix with zero cells."""
    return G.confusion_matrix(preds_multi(spark, sf))


@register("q_confusion_norm")
def q_confusion_norm(spark, sf):
    """Row-normalised confusion matrix."""
    return G.confusion_normalized(preds_multi(spark, sf))


@register("q_class_metrics")
def q_class_metrics(spark, sf):
    """Per-class TP/FP/FN/TN and metrics."""
    return G.class_metrics(preds_multi(spark, sf))


@register("q_mcc")
def q_mcc(spark, sf):
    """Matthews correlation of the 3-class predictions and of each binary model."""
    m = G.mcc(preds_multi(spark, sf)).select(F.lit("multi").alias("model"), "mcc")
    return m.unionByName(G.mcc(preds_binary(spark, sf), ["model"]))


@register("q_auc_binary")
def q_auc_binary(spark, sf):
    """Rank-based AUC per binary model (heavily tied scores)."""
    return G.auc(preds_binary(spark, sf), ["model"], "label", "score")


@register("q_auc_ovr_macro")
def q_auc_ovr_macro(spark, sf):
    """Macro mean of one-vs-rest AUCs."""
    return G.auc_ovr_macro(preds_multi(spark, sf), PROBS)


@register("q_roc_points")
def q_roc_points(spark, sf):
    """ROC points per binary model."""
    return G.roc_points(preds_binary(spark, sf), ["model"], "label", "score")


@register("q_roc_ovr")
def q_roc_ovr(spark, sf):
    """One-vs-rest ROC points and AUC per class."""
    return G.roc_ovr(preds_multi(spark, sf), PROBS)


@register("q_roc_micro")
def q_roc_micro(spark, sf):
    """Micro-average ROC points and AUC."""
    return G.roc_micro(preds_multi(spark, sf), PROBS)


@register("q_roc_macro")
def q_roc_macro(spark, sf):
    """Macro-average ROC on the union FPR grid with its trapezoid AUC."""
    return G.roc_macro(preds_multi(spark, sf), PROBS)


@register("q_roc_ovo")
def q_roc_ovo(spark, sf):
    """One-vs-one AUC per class pair."""
    return G.roc_ovo(preds_multi(spark, sf), PROBS)


@register("q_roc_ovo_points")
def q_roc_ovo_points(spark, sf):
    """One-vs-one curve points per class pair."""
    return G.roc_ovo_points(preds_multi(spark, sf), PROBS)


@register("q_auc_pair_matrix")
def q_auc_pair_matrix(spark, sf):
    """Symmetric pairwise AUC matrix with mean and count."""
    return G.auc_pair_matrix(G.roc_ovo(preds_multi(spark, sf), PROBS))


@register("q_classification_report")
def q_classification_report(spark, sf):
    """Per-class report with accuracy, macro and weighted averages."""
    return G.classification_report(preds_multi(spark, sf))


def _board(spark, sf):
    p = preds_binary(spark, sf)
    times = spark.createDataFrame(list(MODEL_SECONDS.items()), "model string, training_time double")
    return R.leaderboard(p, ["segment", "model"], times)


@register("q_model_ranking")
def q_model_ranking(spark, sf):
    """Models ranked per event-type segment by F1, AUC, MCC, accuracy, time."""
    return R.rank_models(_board(spark, sf), ["segment"])


@register("q_best_model")
def q_best_model(spark, sf):
    """The top-ranked model per segment."""
    return R.best_model(_board(spark, sf), ["segment"])


@register("q_best_by_metric")
def q_best_by_metric(spark, sf):
    """Best model by AUC and by MCC per segment."""
    return R.best_by_metric(_board(spark, sf), ["segment"])
