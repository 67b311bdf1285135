"""Profile queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from loupe.operators import profile as P
from loupe.plans.catalog import register
from loupe.plans.fixtures import dirty_orders
from loupe.sources.tables import load

LINEITEM_NUM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                "l_extendedprice", "l_discount", "l_tax"]


@register("q_table_overview")
def q_table_overview(spark, sf):
    """B2: rows, columns and role counts of lineitem."""
    return P.table_overview(load(spark, sf, "lineitem"))


@register("q_preview")
def q_preview(spark, sf):
    """First 10 orders by key (timestamp shown as text)."""
    o = load(spark, sf, "orders")
    return P.preview(o, ["o_orderkey"], 10).withColumn(
        "o_orderdate", F.col("o_orderdate").cast("string"))


@register("q_column_types")
def q_column_types(spark, sf):
    """Dtype, non-null, null and distinct counts per column of dirty_orders."""
    return P.column_types(dirty_orders(spark, sf))


@register("q_describe")
def q_describe(spark, sf):
    """Numeric describe of lineitem with exact quartiles."""
    return P.describe(load(spark, sf, "lineitem"), LINEITEM_NUM)


@register("q_categorical_summary")
def q_categorical_summary(spark, sf):
    """Distinct count, mode and its frequency per string column of dirty_orders."""
    return P.categorical_summary(dirty_orders(spark, sf))


@register("q_class_distribution")
def q_class_distribution(spark, sf):
    """Class counts and shares of documents.lang."""
    return P.class_distribution(load(spark, sf, "documents"), "lang")
