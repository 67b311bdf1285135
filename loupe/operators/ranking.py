"""Model comparison (G16-G18): leaderboard, ranking, best model.

Rankings run over the metric table (one row per model x segment), never over
predictions, so a window partition holds one segment's models.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loupe.functions.names import all_named, named
from loupe.operators import evaluate as G
from loupe.session import materialize


def leaderboard(preds: DataFrame, keys: Sequence[str], times: DataFrame | None = None) -> DataFrame:
    """Metrics per key (e.g. segment, model): accuracy, weighted P/R/F1, AUC, MCC, time."""
    keys = list(keys)
    counts = materialize(G.confusion_counts(preds, keys))
    m = G.metrics_of_counts(counts, keys)
    a = G.auc(preds, keys, "label", "score")
    c = G.mcc_of_counts(counts, keys)
    out = m.join(a, keys, "left").join(c, keys, "left")
    if times is not None:
        out = out.join(times, "model", "left")
    else:
        out = out.withColumn("training_time", F.lit(None).cast("double"))
    return out


def _order():
    # missing metrics rank as -1; raw (unrounded) values
    f = lambda c: F.coalesce(named(c), F.lit(-1.0)).desc()
    return [f("f1_score"), f("auc"), f("mcc"), f("accuracy"),
            F.coalesce(F.col("training_time"), F.lit(float("inf"))).asc(), F.col("model").asc()]


def rank_models(board: DataFrame, segment: Sequence[str] = ()) -> DataFrame:
    """Rank 1.. per segment by F1, AUC, MCC, accuracy (desc), time (asc)."""
    w = Window.partitionBy(*all_named(segment)).orderBy(*_order())
    return board.select("*", F.row_number().over(w).alias("rank"))


def best_model(board: DataFrame, segment: Sequence[str] = ()) -> DataFrame:
    """The rank-1 model of each segment."""
    return rank_models(board, segment).where(F.col("rank") == 1).drop("rank")


def best_by_metric(board: DataFrame, segment: Sequence[str] = ()) -> DataFrame:
    """Best model by AUC and by MCC per segment (ties to the smaller name);
    rows missing the metric are skipped."""
    seg = list(segment)

    def best(metric: str):
        key = F.when(named(metric).isNotNull(), F.struct((-named(metric)).alias("m"), F.col("model")))
        return F.min_by(F.col("model"), key)

    return board.groupBy(*all_named(seg)).agg(
        best("auc").alias("best_auc_model"), F.max("auc").alias("best_auc"),
        best("mcc").alias("best_mcc_model"), F.max("mcc").alias("best_mcc"))
