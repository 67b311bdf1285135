"""Data-quality issue detection.

Rules follow the reference workbench ("compat" mode):

* missing      — per column null count > 0, percentage of all rows;
* outliers     — numeric non-target columns, IQR fences with exact linear
                 quantiles over non-null values, strict comparison;
* imbalance    — class counts over all rows, flagged when min/max < 0.2;
* cardinality  — string non-target columns, distinct/rows > 50 % or > 20 distinct;
* constant     — numeric columns with sample variance < 1e-7 -> ``constant``;
                 otherwise distinct > 1 and distinct/non-null < 0.01 -> ``near-constant``;
* duplicates   — rows equal to an earlier row (NULLs compare equal).

All detectors read two shared inputs: a summary with one row per column, made in
two stages, and a per-column quantile table.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loupe.functions.names import named
from loupe.functions.ranks import exact_quantiles
from loupe.functions.roles import column_roles, role_of
from loupe.functions.stats import as_double
from loupe.operators.profile import SKETCH_ERROR, cell_value, distinct_counts

# Thresholds of the reference's rules.
IQR_FACTOR = 1.5
IMBALANCE_RATIO = 0.2
HIGH_CARD_SHARE_PCT = 50.0
HIGH_CARD_COUNT = 20
CONSTANT_VARIANCE = 1e-7
NEAR_CONSTANT_RATIO = 0.01


#: A sketched distinct count this many times beyond a rule's threshold cannot meet the rule (the sketch's relative error is 2 %).
SKETCH_MARGIN = 1.5


@dataclass
class IssueInputs:
    """Shared inputs of all detectors, one small row per column.

    Stage one is one aggregate over the table: rows, non-null counts, variances and distinct-count sketches of
    all columns. Stage two counts distinct values exactly, but only of the columns whose sketch leaves it
    open whether a rule flags them, or which a rule flags and reports: unique keys of numeric type
    and measured values are never shuffled. ``distinct_count`` is NULL for the others.
    """

    df: DataFrame
    target: str | None
    summary: DataFrame
    distinct: dict

    @classmethod
    def of(cls, df: DataFrame, target: str | None) -> IssueInputs:
        aggs = [F.count(F.lit(1)).alias("n")]
        for i, c in enumerate(df.columns):
            value = cell_value(df, c)
            numeric = role_of(df.schema[c].dataType) == "numeric"
            aggs += [F.count(value).alias(f"n{i}"), F.approx_count_distinct(value.cast("string"), SKETCH_ERROR).alias(f"d{i}"),
                     (F.var_samp(as_double(named(c))) if numeric else F.lit(None).cast("double")).alias(f"v{i}")]
        r = df.agg(*aggs).first()
        cats = set(column_roles(df, exclude=target).categorical)
        asked = [c for i, c in enumerate(df.columns) if c != target and _needs_distinct(c in cats, r["n"], r[f"n{i}"], r[f"d{i}"], r[f"v{i}"])]
        at = {c: i for i, c in enumerate(df.columns)}
        exact = distinct_counts(df, {c: r[f"d{at[c]}"] for c in asked})
        rows = [(i, c, r["n"], r[f"n{i}"], r["n"] - r[f"n{i}"], exact.get(c), r[f"v{i}"]) for i, c in enumerate(df.columns)]
        summary = df.sparkSession.createDataFrame(
            rows, "ordinal int, column_name string, n_rows long, non_null long, null_count long, distinct_count long, var double")
        return cls(df, target, summary, exact)

    @property
    def n_rows(self):
        return F.col("n_rows")


def _needs_distinct(categorical: bool, rows: int, non_null: int, sketched: int, var: float | None) -> bool:
    """Whether D4 or D5 may flag a column with about ``sketched`` distinct values."""
    if not non_null:
        return False
    high = categorical and (sketched * SKETCH_MARGIN > HIGH_CARD_COUNT or sketched * SKETCH_MARGIN * 100.0 > HIGH_CARD_SHARE_PCT * rows)
    near = sketched < NEAR_CONSTANT_RATIO * non_null * SKETCH_MARGIN
    return high or near or (var is not None and var < CONSTANT_VARIANCE)


def detect_missing(inp: IssueInputs) -> DataFrame:
    """``column_name, missing_count, missing_percentage`` for columns with nulls."""
    s = inp.summary
    return (s.where(F.col("null_count") > 0)
            .select("column_name",
                    F.col("null_count").alias("missing_count"),
                    F.try_divide(F.col("null_count") * 100.0, F.col("n_rows"))
                    .alias("missing_percentage")))


def outlier_bounds(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """IQR fences per column: ``column, n, q1, q3, lower_bound, upper_bound``."""
    q = exact_quantiles(df, cols, [0.25, 0.75], names=["q1", "q3"])
    iqr = F.col("q3") - F.col("q1")
    return q.select("column", "n", "q1", "q3",
                    (F.col("q1") - IQR_FACTOR * iqr).alias("lower_bound"),
                    (F.col("q3") + IQR_FACTOR * iqr).alias("upper_bound"))


def outside_counts(df: DataFrame, fences: list, cols: Sequence[str]) -> dict:
    """``{column: count}`` of values strictly outside the collected fences, one wide aggregate."""
    b = {r["column"]: (r["lower_bound"], r["upper_bound"]) for r in fences}
    aggs = []
    for c in cols:
        if c not in b or b[c][0] is None:
            continue
        v = as_double(named(c))
        out = (v < F.lit(float(b[c][0]))) | (v > F.lit(float(b[c][1])))
        aggs.append(F.coalesce(F.sum(out.cast("long")), F.lit(0)).alias(c))
    if not aggs:
        return {}
    return df.agg(*aggs).first().asDict()


def numeric_features(df: DataFrame, target: str | None) -> list[str]:
    return list(column_roles(df, exclude=target).numerical)


def detect_outliers(inp: IssueInputs, bounds: DataFrame | None = None) -> DataFrame:
    """``column_name, outlier_count, outlier_percentage, lower_bound, upper_bound``.

    The fences (one row per column) are computed once and collected; the
    counts are one wide aggregate; the result is a small table, so later use
    never recomputes the quantiles.
    """
    cols = numeric_features(inp.df, inp.target)
    if not cols:
        return _empty_outliers(inp.df)
    b = bounds if bounds is not None else outlier_bounds(inp.df, cols)
    fences = b.select("column", "n", "lower_bound", "upper_bound").collect()
    counts = outside_counts(inp.df, fences, cols)
    rows = []
    for r in fences:
        k = counts.get(r["column"], 0) or 0
        if k > 0:
            pct = k * 100.0 / r["n"] if r["n"] else None
            rows.append((r["column"], int(k), pct, r["lower_bound"], r["upper_bound"]))
    return inp.df.sparkSession.createDataFrame(
        rows, "column_name string, outlier_count long, outlier_percentage double, "
              "lower_bound double, upper_bound double")


def flagged_bounds(df: DataFrame, target: str | None) -> dict:
    """``{column: (lower, upper)}`` of the numeric features that have IQR outliers.

    Fences and counts only (two passes), for callers that need the bounds
    without the rest of the issue profile.
    """
    cols = numeric_features(df, target)
    if not cols:
        return {}
    fences = outlier_bounds(df, cols).select("column", "lower_bound", "upper_bound").collect()
    counts = outside_counts(df, fences, cols)
    return {r["column"]: (float(r["lower_bound"]), float(r["upper_bound"]))
            for r in fences if (counts.get(r["column"], 0) or 0) > 0}


def _empty_outliers(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame(
        [], "column_name string, outlier_count long, outlier_percentage double, "
            "lower_bound double, upper_bound double")


def class_counts(inp: IssueInputs) -> DataFrame:
    """Per-class counts of the target (nulls excluded; map-side combined)."""
    t = named(inp.target)
    return (inp.df.where(t.isNotNull()).groupBy(t.alias("_t"))
            .agg(F.count(F.lit(1)).alias("class_count"))
            .select(F.col("_t").cast("string").alias("class_value"),
                    F.col("_t").cast("double").alias("class_num") if role_of(
                        inp.df.schema[inp.target].dataType) == "numeric"
                    else F.lit(None).cast("double").alias("class_num"),
                    "class_count"))


def detect_imbalance(inp: IssueInputs) -> DataFrame:
    """D3: one row per class with count, % of all rows, flag and max/min ratio.

    Percentages use all rows (nulls included) as the denominator; the flag
    needs at least two classes.
    """
    if inp.target is None:
        raise ValueError("class imbalance needs a target column")
    cc = class_counts(inp)
    r = cc.agg(F.min("class_count").alias("least"), F.max("class_count").alias("most"), F.count(F.lit(1)).alias("k")).first()
    n = inp.summary.select("n_rows").first()
    least, most = F.lit(r["least"]).cast("long"), F.lit(r["most"]).cast("long")
    flagged = F.lit(r["k"] > 1) & (F.try_divide(least, most) < IMBALANCE_RATIO)
    return cc.select(
        "class_value", "class_count",
        F.try_divide(F.col("class_count") * 100.0, F.lit(n["n_rows"] if n else 0)).alias("class_percentage"),
        flagged.alias("is_imbalanced"),
        F.when(flagged, most / least).alias("imbalance_ratio"))


def detect_high_cardinality(inp: IssueInputs) -> DataFrame:
    """``column_name, unique_count, unique_percentage`` for flagged string columns."""
    cats = list(column_roles(inp.df, exclude=inp.target).categorical)
    pct = F.try_divide(F.col("distinct_count") * 100.0, F.col("n_rows"))
    return (inp.summary.where(F.col("column_name").isin(cats))
            .select("column_name", F.col("distinct_count").alias("unique_count"),
                    pct.alias("unique_percentage"))
            .where((F.col("unique_percentage") > HIGH_CARD_SHARE_PCT)
                   | (F.col("unique_count") > HIGH_CARD_COUNT)))


def detect_constant(inp: IssueInputs) -> DataFrame:
    """``column_name, unique_values, constant_type`` (constant / near-constant)."""
    df = inp.df
    feats = [c for c in df.columns if c != inp.target]
    s = inp.summary.where(F.col("column_name").isin(feats))
    constant = F.col("var").isNotNull() & (F.col("var") < CONSTANT_VARIANCE)
    ratio = F.try_divide(F.col("distinct_count").cast("double"), F.col("non_null"))
    near = (F.coalesce(ratio, F.lit(0.0)) < NEAR_CONSTANT_RATIO) & (F.col("distinct_count") > 1)
    kind = F.when(constant, F.lit("constant")).when(near, F.lit("near-constant"))
    return (s.select("column_name", F.col("distinct_count").alias("unique_values"),
                     kind.alias("constant_type"))
            .where(F.col("constant_type").isNotNull()))


def detect_duplicates(df: DataFrame) -> DataFrame:
    """``duplicate_count, duplicate_percentage`` in one job.

    ``groupBy(all columns)`` treats NULLs as equal (like pandas); a group of
    copies holding a third of the table is pre-aggregated map-side.
    """
    g = df.groupBy(*[named(c) for c in df.columns]).agg(F.count(F.lit(1)).alias("_n"))
    return g.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).cast("long").alias("duplicate_count"),
                 F.coalesce(F.sum("_n"), F.lit(0)).alias("_rows")).select(
        "duplicate_count",
        F.try_divide(F.col("duplicate_count") * 100.0, F.col("_rows")).alias("duplicate_percentage"))


# ---------------------------------------------------------------- D7 / D8

def issue_report(df: DataFrame, target: str | None) -> DataFrame:
    """All findings as ``issue, column_name, detail, metric, value``."""
    inp = IssueInputs.of(df, target)
    return _report(inp)


def _report(inp: IssueInputs) -> DataFrame:
    def tall(d: DataFrame, issue: str, col, detail, metrics: list[str]) -> DataFrame:
        arr = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"))
                        for m in metrics])
        return d.select(F.lit(issue).alias("issue"), col.alias("column_name"),
                        detail.alias("detail"), F.explode(arr).alias("_m")) \
            .select("issue", "column_name", "detail", "_m.metric", "_m.value")

    none = F.lit(None).cast("string")
    parts = [
        tall(detect_missing(inp), "missing_values", F.col("column_name"), none,
             ["missing_count", "missing_percentage"]),
        tall(detect_outliers(inp), "outliers", F.col("column_name"), none,
             ["outlier_count", "outlier_percentage", "lower_bound", "upper_bound"]),
        tall(detect_high_cardinality(inp), "high_cardinality", F.col("column_name"), none,
             ["unique_count", "unique_percentage"]),
        tall(detect_constant(inp), "constant_features", F.col("column_name"),
             F.col("constant_type"), ["unique_values"]),
        tall(detect_duplicates(inp.df), "duplicate_rows", none, none,
             ["duplicate_count", "duplicate_percentage"]),
    ]
    if inp.target is not None:
        imb = detect_imbalance(inp).withColumn("flag", F.col("is_imbalanced").cast("double"))
        parts.append(tall(imb, "class_imbalance", F.lit(inp.target), F.col("class_value"),
                          ["class_count", "class_percentage", "flag", "imbalance_ratio"]))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def issue_count(df: DataFrame, target: str | None) -> DataFrame:
    """Findings per issue kind plus ``total`` (always all six kinds).

    One per column-level finding, one for an imbalanced target, one when
    duplicates exist. The report is tiny, so this is one small aggregate.
    """
    rep = issue_report(df, target)
    iss, met = F.col("issue"), F.col("metric")
    per_col = [F.count_distinct(F.when(iss == k, F.col("column_name"))).alias(k)
               for k in ("missing_values", "outliers", "high_cardinality", "constant_features")]
    flag = lambda cond: F.coalesce(F.max(F.when(cond, 1).otherwise(0)), F.lit(0))
    flags = [
        flag((iss == "class_imbalance") & (met == "flag") & (F.col("value") > 0))
        .alias("class_imbalance"),
        flag((iss == "duplicate_rows") & (met == "duplicate_count") & (F.col("value") > 0))
        .alias("duplicate_rows"),
    ]
    wide = rep.agg(*per_col, *flags)
    kinds = ["missing_values", "outliers", "class_imbalance", "high_cardinality",
             "constant_features", "duplicate_rows"]
    total = sum((named(k) for k in kinds[1:]), F.col(kinds[0]))
    rows = F.array(*[F.struct(F.lit(k).alias("issue"), named(k).cast("long").alias("n"))
                     for k in kinds],
                   F.struct(F.lit("total").alias("issue"), total.cast("long").alias("n")))
    return wide.select(F.explode(rows).alias("_r")).select("_r.issue", "_r.n")
