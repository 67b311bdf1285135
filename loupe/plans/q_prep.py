"""Preprocessing queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from loupe.operators import issues as I
from loupe.operators import prep as P
from loupe.operators import scale as S
from loupe.operators import split as SP
from loupe.operators.balance import class_weights
from loupe.plans.catalog import register
from loupe.plans.fixtures import dirty_orders, nan_orders, planted_lineitem
from loupe.plans.q_eda import DIRTY_FEATURES
from loupe.sources.tables import load

DIRTY_CATS = ["priority", "city", "const_str", "status"]
PLANTED_FEATURES = ["l_quantity", "l_discount", "l_tax", "l_extendedprice"]


@register("q_dedupe")
def q_dedupe(spark, sf):
    """dirty_orders without duplicate rows."""
    return P.drop_duplicates(dirty_orders(spark, sf))


@register("q_drop_constant")
def q_drop_constant(spark, sf):
    """dirty_orders without the columns D5 flags."""
    d = dirty_orders(spark, sf)
    flagged = [r["column_name"] for r in
               I.detect_constant(I.IssueInputs.of(d, "target")).select("column_name").collect()]
    return P.drop_columns(d, flagged)


def _impute_numeric(spark, sf, strategy):
    d = dirty_orders(spark, sf).select(*DIRTY_FEATURES)
    return P.apply_numeric_imputer(d, P.fit_numeric_imputer(d, DIRTY_FEATURES, strategy),
                                   DIRTY_FEATURES)


@register("q_impute_numeric_mean")
def q_impute_numeric_mean(spark, sf):
    """Numeric features imputed with the column mean."""
    return _impute_numeric(spark, sf, "mean")


@register("q_impute_numeric_median")
def q_impute_numeric_median(spark, sf):
    """Numeric features imputed with the exact median."""
    return _impute_numeric(spark, sf, "median")


@register("q_impute_numeric_mode")
def q_impute_numeric_mode(spark, sf):
    """Numeric features imputed with the most frequent value (smallest on ties)."""
    return _impute_numeric(spark, sf, "most_frequent")


@register("q_impute_categorical")
def q_impute_categorical(spark, sf):
    """E5: string features imputed with the most frequent value."""
    d = dirty_orders(spark, sf).select("o_orderkey", *DIRTY_CATS)
    return P.apply_categorical_imputer(d, P.fit_categorical_imputer(d, DIRTY_CATS))


@register("q_impute_categorical_constant")
def q_impute_categorical_constant(spark, sf):
    """E5: string features imputed with the constant 'Unknown'."""
    d = dirty_orders(spark, sf).select("o_orderkey", *DIRTY_CATS)
    return P.apply_categorical_imputer(d, P.fit_categorical_imputer(d, DIRTY_CATS, "constant"))


def _raw_bounds(spark, sf):
    return I.flagged_bounds(dirty_orders(spark, sf), "target")


@register("q_cap_outliers")
def q_cap_outliers(spark, sf):
    """Flagged columns clipped to the raw table's IQR fences."""
    d = dirty_orders(spark, sf).select("o_orderkey", "price", "tenure")
    return P.cap_outliers(d, _raw_bounds(spark, sf))


@register("q_remove_outliers")
def q_remove_outliers(spark, sf):
    """Rows inside every flagged column's fences."""
    d = dirty_orders(spark, sf).select("o_orderkey", "price", "tenure", "target")
    return P.remove_outliers(d, _raw_bounds(spark, sf))


@register("q_group_rare")
def q_group_rare(spark, sf):
    """Conversation roles under 5 % of non-null values become 'Other'."""
    c = load(spark, sf, "conversations").select("conv_id", "turn", "role")
    return P.apply_group_rare(c, P.fit_frequent_values(c, ["role"], P.RARE_THRESHOLD))


@register("q_auto_impute")
def q_auto_impute(spark, sf):
    """Median / most-frequent safety imputation of every feature still holding nulls."""
    out, _ = P.auto_impute(dirty_orders(spark, sf), exclude=["target"])
    return out


@register("q_one_hot")
def q_one_hot(spark, sf):
    """One-hot columns for priority and status, first category dropped."""
    d = dirty_orders(spark, sf).select("o_orderkey", "priority", "status")
    return P.apply_one_hot(d, P.fit_one_hot(d, ["priority", "status"]))


@register("q_one_hot_sparse")
def q_one_hot_sparse(spark, sf):
    """The positions that are 1 in the sparse one-hot vector of order key, city and priority (one column has a category for every order)."""
    d = dirty_orders(spark, sf).select("o_orderkey", F.concat(F.lit("k"), F.col("o_orderkey").cast("string")).alias("key"), "city", "priority")
    fitted = P.fit_one_hot_sparse(d, ["key", "city", "priority"])
    return P.apply_one_hot_sparse(d, fitted).select("o_orderkey", F.explode("one_hot").alias("place"))


@register("q_label_encode")
def q_label_encode(spark, sf):
    """City and priority replaced by their sorted rank (NULL encoded as 'nan')."""
    d = dirty_orders(spark, sf).select("o_orderkey", "city", "priority")
    return P.label_encode(d, ["city", "priority"])


@register("q_target_encode_labels")
def q_target_encode_labels(spark, sf):
    """String target documents.lang encoded as 0..k-1."""
    d = load(spark, sf, "documents").select("doc_id", "lang")
    return P.apply_label_encoding(d, "lang", P.label_dictionary(d, "lang"), out="label")


@register("q_stratified_split")
def q_stratified_split(spark, sf):
    """Stratified 80/20 split of dirty_orders by target, seed 42."""
    d = dirty_orders(spark, sf).select("o_orderkey", "target")
    return SP.stratified_split(d, "target", ["o_orderkey"], 0.2, 42)


@register("q_random_split")
def q_random_split(spark, sf):
    """Plain 80/20 split of dirty_orders in hash order."""
    d = dirty_orders(spark, sf).select("o_orderkey", "target")
    return SP.random_split(d, ["o_orderkey"], 0.2, 42)


@register("q_undersample")
def q_undersample(spark, sf):
    """Each class cut to the minority count."""
    d = dirty_orders(spark, sf).select("o_orderkey", "target")
    return SP.undersample(d, "target", ["o_orderkey"], 42)


@register("q_class_weights")
def q_class_weights(spark, sf):
    """Balanced class weights of dirty_orders.target."""
    return class_weights(dirty_orders(spark, sf), "target")


def _planted_scaled(spark, sf, kind):
    d = planted_lineitem(spark, sf).select("row_key", "split", *PLANTED_FEATURES)
    train = d.where(F.col("split") == "train")
    if kind == "standard":
        return S.apply_standard(d, S.fit_standard(train, PLANTED_FEATURES))
    return S.apply_minmax(d, S.fit_minmax(train, PLANTED_FEATURES))


@register("q_standard_scale")
def q_standard_scale(spark, sf):
    """Standard scaling fitted on the train rows (ddof=0), applied to all."""
    return _planted_scaled(spark, sf, "standard")


@register("q_minmax_scale")
def q_minmax_scale(spark, sf):
    """Min-max scaling fitted on the train rows, applied to all."""
    return _planted_scaled(spark, sf, "minmax")


@register("q_train_class_distribution")
def q_train_class_distribution(spark, sf):
    """Class table of the stratified training rows."""
    d = dirty_orders(spark, sf).select("o_orderkey", "target")
    s = SP.stratified_split(d, "target", ["o_orderkey"], 0.2, 42)
    return P.class_table(s.where(F.col("split") == "train"), "target")


@register("q_impute_nan")
def q_impute_nan(spark, sf):
    """E4 on NaN and NULL prices: both get the median of the others."""
    d = nan_orders(spark, sf)
    return P.apply_numeric_imputer(d, P.fit_numeric_imputer(d, ["price", "tenure"], "median"), ["price", "tenure"])


@register("q_cap_nan")
def q_cap_nan(spark, sf):
    """E6 on NaN and NULL prices: both stay missing, the others are capped at the IQR fences."""
    d = nan_orders(spark, sf)
    return P.cap_outliers(d, I.flagged_bounds(d.select("price", "tenure"), None))


@register("q_prep_summary")
def q_prep_summary(spark, sf):
    """Step log of the full preparation chain on dirty_orders."""
    from loupe.plans.workflow import prepare
    res = prepare(dirty_orders(spark, sf), "target", ["o_orderkey"], P.PrepConfig(
        outlier_handling="remove", fix_high_cardinality=True))
    return res.summary


@register("q_smote")
def q_smote(spark, sf):
    """SMOTE (k=5, seed 42) on the planted training rows; returns class counts."""
    from loupe.operators.balance import smote
    train = planted_lineitem(spark, sf).where(F.col("split") == "train") \
        .withColumn("rid", F.xxhash64("row_key"))
    out = smote(train, PLANTED_FEATURES, "label", "rid")
    return out.groupBy("label", "synthetic").agg(F.count(F.lit(1)).alias("rows"))
