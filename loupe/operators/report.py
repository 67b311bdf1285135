"""Report table (H1) and results sink formatting (A3 helpers).

The report is one tall ``section, item, value, text`` DataFrame: overview,
class distribution, missing values, outliers and class imbalance. It is the
data behind the reference's Markdown/PDF report, which is rendering only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loupe.functions.names import named
from loupe.functions.roles import column_roles
from loupe.operators import issues as I


def _rows(df: DataFrame, section: str, item, metrics: list[tuple[str, str]]) -> DataFrame:
    arr = F.array(*[F.struct(F.lit(label).alias("m"), named(col).cast("double").alias("v"))
                    for label, col in metrics])
    x = df.select(item.alias("_item"), F.explode(arr).alias("_x"))
    return x.select(F.lit(section).alias("section"),
                    F.concat_ws(":", F.col("_item"), F.col("_x.m")).alias("item"),
                    F.col("_x.v").alias("value"), F.lit(None).cast("string").alias("text"))


def report_tables(df: DataFrame, target: str) -> DataFrame:
    """H1: the data-report sections as one table, computed from the shared issue inputs."""
    inp = I.IssueInputs.of(df, target)
    roles = column_roles(df, exclude=target)
    classes = I.class_counts(inp).count()
    stats = inp.summary.where(F.col("column_name") == target).select("n_rows", F.lit(classes).alias("k"))
    none_d, none_s = F.lit(None).cast("double"), F.lit(None).cast("string")

    def item(name, value, text):
        return F.struct(F.lit(name).alias("item"), value.cast("double").alias("value"),
                        text.cast("string").alias("text"))

    overview = stats.select(F.explode(F.array(
        item("samples", F.col("n_rows"), none_s),
        item("features", F.lit(float(len(df.columns) - 1)), none_s),
        item("target", none_d, F.lit(target)),
        item("classes", F.col("k"), none_s),
        item("problem_type", none_d,
             F.when(F.col("k") == 2, F.lit("Binary")).otherwise(F.lit("Multiclass"))),
        item("numerical_features", F.lit(float(len(roles.numerical))), none_s),
        item("categorical_features", F.lit(float(len(roles.categorical))), none_s),
    )).alias("_o")).select(F.lit("overview").alias("section"), "_o.item", "_o.value", "_o.text")
    imb = I.detect_imbalance(inp)
    dist = _rows(imb, "class_distribution", F.col("class_value"),
                 [("count", "class_count"), ("percentage", "class_percentage")])
    miss = _rows(I.detect_missing(inp), "missing_values", F.col("column_name"),
                 [("count", "missing_count"), ("percentage", "missing_percentage")])
    outl = _rows(I.detect_outliers(inp), "outliers", F.col("column_name"),
                 [("count", "outlier_count"), ("percentage", "outlier_percentage")])
    flag = imb.agg(F.max(F.col("is_imbalanced").cast("double")).alias("f"),
                   F.max("imbalance_ratio").alias("r"))
    imbalance = flag.select(F.explode(F.array(
        F.struct(F.lit("is_imbalanced").alias("item"), F.col("f").alias("value")),
        F.struct(F.lit("imbalance_ratio").alias("item"), F.col("r").alias("value")))).alias("_i")) \
        .select(F.lit("class_imbalance").alias("section"), "_i.item", "_i.value",
                F.lit(None).cast("string").alias("text"))
    return overview.unionByName(dist).unionByName(miss).unionByName(outl).unionByName(imbalance)


def for_csv(df: DataFrame, missing: str = "N/A") -> DataFrame:
    """A3 formatting: every column as text, missing values printed as ``N/A``."""
    return df.select(*[F.coalesce(named(c).cast("string"), F.lit(missing)).alias(c)
                       for c in df.columns])
