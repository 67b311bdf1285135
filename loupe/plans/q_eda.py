"""Exploratory-analysis queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from loupe.operators import eda as E
from loupe.plans.catalog import register
from loupe.plans.fixtures import LINEITEM_KEY, dirty_orders, nan_orders
from loupe.plans.q_profile import LINEITEM_NUM
from loupe.sources.tables import load

DIRTY_FEATURES = ["o_orderkey", "o_custkey", "price", "tenure", "const_num"]
EVENTS_NUM = ["event_id", "user_id", "value"]


@register("q_missing_summary")
def q_missing_summary(spark, sf):
    """Missing count and % per column (2 dp)."""
    return E.missing_summary(dirty_orders(spark, sf))


@register("q_missing_global")
def q_missing_global(spark, sf):
    """Global missing share of all cells."""
    return E.missing_global(dirty_orders(spark, sf))


@register("q_missing_patterns")
def q_missing_patterns(spark, sf):
    """Missingness patterns with row counts."""
    return E.missing_patterns(dirty_orders(spark, sf))


@register("q_outliers_iqr")
def q_outliers_iqr(spark, sf):
    """IQR outliers with fences over the numeric columns of events."""
    return E.outliers_iqr(load(spark, sf, "events"), EVENTS_NUM)


@register("q_outliers_zscore")
def q_outliers_zscore(spark, sf):
    """|z| > 3 outliers (population std) over events and dirty_orders features."""
    a = E.outliers_zscore(load(spark, sf, "events"), EVENTS_NUM)
    b = E.outliers_zscore(dirty_orders(spark, sf), DIRTY_FEATURES)
    return a.unionByName(b)


@register("q_boxplot")
def q_boxplot(spark, sf):
    """Box-plot statistics of events.value and events.user_id."""
    return E.boxplot(load(spark, sf, "events"), ["value", "user_id"])


@register("q_histogram")
def q_histogram(spark, sf):
    """30-bin histograms of events.value and events.user_id."""
    return E.histogram(load(spark, sf, "events"), ["value", "user_id"], 30)


@register("q_correlation_matrix")
def q_correlation_matrix(spark, sf):
    """Pearson matrix of dirty_orders numerics (target included, a constant column)."""
    return E.correlation_matrix(dirty_orders(spark, sf), [*DIRTY_FEATURES, "target"])


@register("q_target_correlation")
def q_target_correlation(spark, sf):
    """Correlation of each numeric feature with the target (3 dp)."""
    c = E.correlation_matrix(dirty_orders(spark, sf), [*DIRTY_FEATURES, "target"])
    return E.target_correlation(c, "target")


@register("q_high_corr_pairs")
def q_high_corr_pairs(spark, sf):
    """C11: lineitem numeric pairs with |r| > 0.8."""
    return E.high_corr_pairs(load(spark, sf, "lineitem"), LINEITEM_NUM)


@register("q_moments")
def q_moments(spark, sf):
    """Mean, median, std, var, bias-corrected skewness and kurtosis."""
    return E.moments(dirty_orders(spark, sf), DIRTY_FEATURES)


@register("q_qq_fit")
def q_qq_fit(spark, sf):
    """Q-Q line fit of events.value and lineitem-free dirty price against the normal."""
    return E.qq_fit(load(spark, sf, "events"), ["value", "user_id"])


@register("q_sample_cap")
def q_sample_cap(spark, sf):
    """C14: at most 100,000 lineitem rows by a seeded hash order."""
    key = list(LINEITEM_KEY)
    li = load(spark, sf, "lineitem").select(*key, "l_extendedprice")
    return E.sample_cap(li, key, E.QQ_SAMPLE_CAP, 42)


@register("q_sample_cap_small")
def q_sample_cap_small(spark, sf):
    """C14 where the cap bites: 500 orders by a seeded hash order."""
    return E.sample_cap(load(spark, sf, "orders").select("o_orderkey", "o_totalprice"), ["o_orderkey"], 500, 42)


@register("q_high_corr_derived")
def q_high_corr_derived(spark, sf):
    """C11 with pairs above the threshold: lineitem numbers, the gross price and the negative quantity."""
    li = load(spark, sf, "lineitem").select(
        *LINEITEM_NUM, (F.col("l_extendedprice") * (1 + F.col("l_tax"))).alias("gross"), (-F.col("l_quantity")).alias("returned"))
    return E.high_corr_pairs(li, [*LINEITEM_NUM, "gross", "returned"])


@register("q_missing_summary_nan")
def q_missing_summary_nan(spark, sf):
    """C1 on dirty_orders with NaN cells beside NULL ones: both are missing."""
    return E.missing_summary(nan_orders(spark, sf))


@register("q_boxplot_by_class")
def q_boxplot_by_class(spark, sf):
    """Documents.n_chars box-plot statistics per language."""
    return E.boxplot(load(spark, sf, "documents"), ["n_chars"], ["lang"])


@register("q_value_counts")
def q_value_counts(spark, sf):
    """Value counts of dirty_orders.priority with % of all rows."""
    return E.value_counts(dirty_orders(spark, sf), "priority")


@register("q_crosstab_pct")
def q_crosstab_pct(spark, sf):
    """C17: priority x target, row-normalised %."""
    return E.crosstab_pct(dirty_orders(spark, sf), "priority", "target")


@register("q_split_sizes")
def q_split_sizes(spark, sf):
    """train/test sizes for test shares 10..40 %."""
    return E.split_sizes(load(spark, sf, "lineitem"))
