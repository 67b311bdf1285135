"""Exploratory analysis.

Every statistic is an aggregate over the whole table; results are tall
``(column, ...)`` DataFrames so that any number of columns costs one job.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loupe.functions.names import all_named, named
from loupe.functions.gram import pairwise_moments, pearson_from_moments
from loupe.functions.ranks import exact_quantiles, row_ranks, tall_values
from loupe.functions.stats import as_double, is_missing, norm_ppf, safe_corr, sample_kurtosis, sample_skewness
from loupe.operators.issues import IQR_FACTOR, outlier_bounds, outside_counts
from loupe.session import attach_row, join_small

Z_THRESHOLD = 3.0
HIGH_CORR = 0.8
QQ_SAMPLE_CAP = 100_000
SPLIT_TEST_PCTS = (10, 15, 20, 25, 30, 35, 40)


def _explode_structs(df: DataFrame, structs: list) -> DataFrame:
    return df.agg(F.array(*structs).alias("_a")).select(F.explode("_a").alias("_s")).select("_s.*")


# ---------------------------------------------------------------- C1 - C3 missing

def missing_summary(df: DataFrame, digits: int = 2) -> DataFrame:
    """``column_name, missing_count, missing_percentage`` (>0 only)."""
    n = F.count(F.lit(1))
    rows = _explode_structs(df, [
        F.struct(F.lit(c).alias("column_name"),
                 F.sum(is_missing(df, c).cast("long")).alias("missing_count"),
                 n.alias("_n")) for c in df.columns])
    return (rows.where(F.col("missing_count") > 0)
            .select("column_name", "missing_count",
                    F.round(F.try_divide(F.col("missing_count") * 100.0, F.col("_n")), digits)
                    .alias("missing_percentage")))


def missing_global(df: DataFrame) -> DataFrame:
    """Total missing cells over rows x columns."""
    k = len(df.columns)
    miss = sum((F.sum(is_missing(df, c).cast("long")) for c in df.columns[1:]),
               F.sum(is_missing(df, df.columns[0]).cast("long")))
    r = df.agg(miss.alias("total_missing"), F.count(F.lit(1)).alias("_n"))
    cells = F.col("_n") * k
    return r.select("total_missing", cells.alias("total_cells"),
                    F.round(F.try_divide(F.col("total_missing") * 100.0, cells), 2)
                    .alias("global_missing_percentage"))


def missing_patterns(df: DataFrame) -> DataFrame:
    """C3 (re-aimed): distinct missingness patterns with their row counts."""
    names = F.concat_ws(",", *[F.when(is_missing(df, c), F.lit(c)) for c in df.columns])
    k = sum((is_missing(df, c).cast("int") for c in df.columns[1:]),
            is_missing(df, df.columns[0]).cast("int"))
    return df.groupBy(names.alias("missing_columns"), k.cast("long").alias("n_missing")) \
        .agg(F.count(F.lit(1)).alias("row_count"))


# ---------------------------------------------------------------- C4 - C8 outliers, shape

def outliers_iqr(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Per column n, quartiles, fences, IQR outlier count and % (2 dp)."""
    fences = outlier_bounds(df, cols).collect()  # one row per column
    outside = outside_counts(df, fences, cols)
    rows = [(r["column"], r["n"], r["q1"], r["q3"], r["lower_bound"], r["upper_bound"], outside.get(r["column"], 0)) for r in fences]
    out = df.sparkSession.createDataFrame(
        rows, "column_name string, n long, q1 double, q3 double, lower_bound double, upper_bound double, iqr_outliers long")
    return out.select("*", F.round(F.try_divide(F.col("iqr_outliers") * 100.0, F.col("n")), 2).alias("iqr_percentage"))


def outliers_zscore(df: DataFrame, cols: Sequence[str], threshold: float = Z_THRESHOLD) -> DataFrame:
    """Count with |z| > 3, z by population std; a constant column has none."""
    vs = {c: as_double(named(c)) for c in cols}
    r = df.agg(*[f(v).alias(f"{n}{i}") for i, v in enumerate(vs.values()) for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    aggs = []
    for i, v in enumerate(vs.values()):
        far = F.abs((v - F.lit(r[f"m{i}"])) / F.lit(r[f"s{i}"])) > threshold if r[f"s{i}"] else F.lit(False)
        aggs += [F.count(v).alias(f"n{i}"), F.coalesce(F.sum((far & v.isNotNull()).cast("long")), F.lit(0)).alias(f"z{i}")]
    k = df.agg(*aggs).first()
    rows = [(c, k[f"n{i}"], k[f"z{i}"]) for i, c in enumerate(cols) if k[f"n{i}"]]
    out = df.sparkSession.createDataFrame(rows, "column_name string, n long, zscore_outliers long")
    return out.select("*", F.round(F.try_divide(F.col("zscore_outliers") * 100.0, F.col("n")), 2).alias("zscore_percentage"))


def boxplot(df: DataFrame, cols: Sequence[str], group_cols: Sequence[str] = ()) -> DataFrame:
    """Min, q1, median, q3, max, whiskers (extreme values inside the fences), outliers."""
    keys = [*group_cols, "column"]
    q = exact_quantiles(df, cols, [0.25, 0.5, 0.75], group_cols, names=["q1", "median", "q3"])
    iqr = F.col("q3") - F.col("q1")
    q = q.select("*", (F.col("q1") - IQR_FACTOR * iqr).alias("_lo"),
                 (F.col("q3") + IQR_FACTOR * iqr).alias("_hi"))
    t = join_small(tall_values(df, cols, group_cols), q.select(*all_named(keys), "_lo", "_hi"), keys)
    inside = (F.col("v") >= F.col("_lo")) & (F.col("v") <= F.col("_hi"))
    a = t.groupBy(*all_named(keys)).agg(
        F.min("v").alias("min"), F.max("v").alias("max"),
        F.min(F.when(inside, F.col("v"))).alias("lower_whisker"),
        F.max(F.when(inside, F.col("v"))).alias("upper_whisker"),
        F.sum((~inside).cast("long")).alias("n_outliers"))
    out = q.join(a, keys)
    return out.select(*all_named(group_cols), F.col("column").alias("column_name"), "n", "min", "q1",
                      "median", "q3", "max", "lower_whisker", "upper_whisker", "n_outliers")


def histogram(df: DataFrame, cols: Sequence[str], bins: int = 30) -> DataFrame:
    """Fixed equal-width bins between min and max; the max falls in the last bin."""
    m = _explode_structs(df, [
        F.struct(F.lit(c).alias("column"), F.min(as_double(c)).alias("lo"),
                 F.max(as_double(c)).alias("hi")) for c in cols])
    t = tall_values(df, cols).join(F.broadcast(m), "column")
    width = F.col("hi") - F.col("lo")
    raw = F.floor(F.try_divide(F.col("v") - F.col("lo"), F.when(width > 0, width)) * bins)
    b = F.least(F.coalesce(raw, F.lit(0)), F.lit(bins - 1)).cast("long")
    g = t.groupBy("column", b.alias("bin"), "lo", "hi").agg(F.count(F.lit(1)).alias("count"))
    w = (F.col("hi") - F.col("lo")) / bins
    return g.select(F.col("column").alias("column_name"), "bin",
                    (F.col("lo") + F.col("bin") * w).alias("bin_start"),
                    (F.col("lo") + (F.col("bin") + 1) * w).alias("bin_end"), "count")


# ---------------------------------------------------------------- C9 - C12 correlation, moments

def correlation_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Full Pearson matrix ``col_a, col_b, correlation``.

    Pairwise-complete rows; NULL where a side is constant; the diagonal is 1
    unless the column is constant. Computed from partition-local masked Gram
    matrices (see :mod:`loupe.functions.gram`): one scan, k^2-row shuffle.
    """
    return pearson_from_moments(pairwise_moments(df, cols))


def target_correlation(corr: DataFrame, target: str, digits: int = 3) -> DataFrame:
    """Correlation of each feature with the (numeric) target, 3 dp."""
    return (corr.where((F.col("col_b") == target) & (F.col("col_a") != target))
            .select(F.col("col_a").alias("feature"),
                    F.round("correlation", digits).alias("correlation")))


def high_corr_pairs(df: DataFrame, cols: Sequence[str], threshold: float = HIGH_CORR) -> DataFrame:
    """C11: pairs i<j (schema order) with |r| > 0.8, 3 dp."""
    cols = list(cols)
    pos = F.create_map(*[x for i, c in enumerate(cols) for x in (F.lit(c), F.lit(i))])
    c = correlation_matrix(df, cols)
    return (c.where((pos[F.col("col_a")] < pos[F.col("col_b")])
                    & (F.abs(F.col("correlation")) > threshold))
            .select(F.col("col_a").alias("feature_1"), F.col("col_b").alias("feature_2"),
                    F.round("correlation", 3).alias("correlation")))


def moments(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Mean, median, std, var (ddof=1), bias-corrected skewness and excess kurtosis.

    One aggregate for the moments (a small row kept as parameters), then the exact
    median as the second pass.
    """
    cols = list(cols)
    aggs = []
    for i, c in enumerate(cols):
        v = as_double(c)
        aggs += [F.avg(v).alias(f"m{i}"), F.stddev_samp(v).alias(f"s{i}"),
                 F.var_samp(v).alias(f"v{i}"), sample_skewness(v).alias(f"g{i}"),
                 sample_kurtosis(v).alias(f"k{i}")]
    r = df.agg(*aggs).collect()[0]
    rows = [(c, r[f"m{i}"], r[f"s{i}"], r[f"v{i}"], r[f"g{i}"], r[f"k{i}"])
            for i, c in enumerate(cols)]
    m = df.sparkSession.createDataFrame(
        rows, "column string, mean double, std double, var double, skewness double, kurtosis double")
    q = exact_quantiles(df, cols, [0.5], names=["median"])
    return m.join(q.select("column", "median"), "column").select(
        F.col("column").alias("column_name"), "mean", "median", "std", "var", "skewness",
        "kurtosis")


# ---------------------------------------------------------------- C13 - C14 Q-Q, sample cap

def sample_cap(df: DataFrame, key: Sequence[str], n: int = QQ_SAMPLE_CAP, seed: int = 42) -> DataFrame:
    """C14: exactly ``min(n, rows)`` rows chosen by a seeded hash order of the key.

    A cut on the hash first leaves a little more than ``n`` rows of the whole table, so the
    merge of the tasks' smallest rows sees about ``n`` rows however many tasks there are.
    Should equal keys leave too few, the uncut table is used.
    """
    h = F.md5(F.concat(F.concat_ws("-", *[named(k).cast("string") for k in key]),
                       F.lit(f":{seed}")))
    hashed = df.withColumn("_h", h)
    rows = df.count()
    share = (n + 10 * n ** 0.5 + 100) / max(rows, 1)
    if share < 1:
        cut = hashed.where(F.substring("_h", 1, 8) < f"{int(share * 16 ** 8):08x}")
        if cut.limit(n).count() == n:
            hashed = cut
    return hashed.orderBy("_h", *key).limit(n).drop("_h")


def qq_points(df: DataFrame, col: str) -> DataFrame:
    """Ordered values against normal order-statistic medians (Filliben).

    Ranks come from the range-partitioned ``row_ranks`` — no global window.
    """
    v = df.select(as_double(col).alias("value")).where(F.col("value").isNotNull())
    r = row_ranks(v, [], ["value"])
    n = F.col("_total").cast("double")
    i = (F.col("_rank") + 1).cast("double")
    last = F.pow(F.lit(0.5), 1.0 / n)
    m = (F.when(i == n, last).when(i == 1, 1.0 - last)
         .otherwise((i - 0.3175) / (n + 0.365)))
    return r.select(F.lit(col).alias("column_name"), (F.col("_rank") + 1).alias("position"),
                    "value", norm_ppf(m).alias("theoretical"))


def qq_fit(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Least-squares line of the Q-Q points: slope, intercept, r per column."""
    parts = [qq_points(df, c) for c in cols]
    pts = parts[0]
    for p in parts[1:]:
        pts = pts.unionByName(p)
    return pts.groupBy("column_name").agg(
        F.count(F.lit(1)).alias("n"),
        F.regr_slope("value", "theoretical").alias("slope"),
        F.regr_intercept("value", "theoretical").alias("intercept"),
        safe_corr("value", "theoretical").alias("r"))


# ---------------------------------------------------------------- C16 - C18 categorical, split

def value_counts(df: DataFrame, col: str, digits: int = 2) -> DataFrame:
    """Value counts (nulls dropped) with % of *all* rows.

    The row total is a one-row aggregate sent to the tasks, so a column
    with millions of distinct values never meets a window without partitions.
    """
    g = df.groupBy(named(col).alias("_v")).agg(F.count(F.lit(1)).alias("count"))
    j = attach_row(g, g.agg(F.sum("count").alias("_n")))
    return (j.where(F.col("_v").isNotNull())
            .select(F.col("_v").cast("string").alias("category"), "count",
                    F.round(F.try_divide(F.col("count") * 100.0, F.col("_n")), digits)
                    .alias("percentage")))


def crosstab_pct(df: DataFrame, feature: str, target: str, digits: int = 2) -> DataFrame:
    """C17: category x class counts, row-normalised to %; zero cells appear as 0.

    The class list (one row per class) is gathered into an array and
    exploded against each category, so the grid never needs a join.
    """
    d = df.where(named(feature).isNotNull() & named(target).isNotNull()) \
        .select(named(feature).cast("string").alias("category"),
                named(target).cast("string").alias("class_value"))
    cnt = d.groupBy("category", "class_value").agg(F.count(F.lit(1)).alias("count"))
    classes = cnt.select("class_value").distinct().agg(F.collect_list("class_value").alias("_cl"))
    cats = cnt.select("category").distinct()
    grid = attach_row(cats, classes).select("category", F.explode("_cl").alias("class_value"))
    full = grid.join(cnt, ["category", "class_value"], "left") \
        .select("category", "class_value", F.coalesce(F.col("count"), F.lit(0)).alias("count"))
    row_total = F.sum("count").over(Window.partitionBy("category"))
    return full.select("category", "class_value", "count",
                       F.round(F.try_divide(F.col("count") * 100.0, row_total), digits)
                       .alias("percentage"))


def split_sizes(df: DataFrame, test_pcts: Sequence[int] = SPLIT_TEST_PCTS) -> DataFrame:
    """train = floor(n * (100 - t) / 100), test = n - train for each t."""
    n = df.agg(F.count(F.lit(1)).alias("n_total"))
    rows = F.array(*[F.lit(t) for t in test_pcts])
    t = n.select("n_total", F.explode(rows).alias("test_percentage"))
    train = F.floor(F.col("n_total") * (100 - F.col("test_percentage")) / 100).cast("long")
    return t.select(F.col("test_percentage").cast("long").alias("test_percentage"), "n_total",
                    train.alias("n_train"), (F.col("n_total") - train).alias("n_test"))
