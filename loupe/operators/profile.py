"""Table and column profile.

The centre is the *tall profile*: every cell becomes ``(column, value)``,
grouped to ``(column, value) -> cnt`` in one shuffle with map-side combine.
A second, tiny aggregation per column yields nulls, distinct count, mode and
mode frequency for all columns at once. This replaces one
``count(distinct)`` per column (which Catalyst expands into rows x columns).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loupe.functions.names import all_named, named
from loupe.functions.ranks import exact_quantiles
from loupe.functions.roles import FLOATING_TYPES, column_roles, role_of, type_name
from loupe.functions.stats import as_double
from loupe.session import attach_row


def _cell_struct(df: DataFrame, i: int, name: str):
    dt = df.schema[name].dataType
    c = named(name)
    if isinstance(dt, FLOATING_TYPES) or isinstance(dt, T.DecimalType):
        d = as_double(c) + F.lit(0.0)  # folds -0.0 into 0.0, NaN -> NULL
        sval, num = d.cast("string"), d
    elif role_of(dt) == "numeric":
        sval, num = c.cast("string"), c.cast("double")
    else:
        sval, num = c.cast("string"), F.lit(None).cast("double")
    return F.struct(
        F.lit(i).alias("ordinal"), F.lit(name).alias("column_name"),
        sval.alias("value"), num.alias("num"),
    )


def value_counts_tall(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """``(ordinal, column_name, value, num, cnt)``; ``value`` is NULL for the null cells."""
    cols = list(cols) if cols is not None else df.columns
    items = F.array(*[_cell_struct(df, i, c) for i, c in enumerate(cols)])
    cells = df.select(F.explode(items).alias("_c")).select("_c.*")
    return cells.groupBy("ordinal", "column_name", "value", "num").agg(
        F.count(F.lit(1)).alias("cnt"))


def column_summary(tall: DataFrame) -> DataFrame:
    """Per column: rows, non_null, null_count, distinct_count, mode, mode_num, mode_freq.

    Mode ties go to the smallest value (numerically for numbers).
    """
    nn = F.col("value").isNotNull()
    order_key = F.struct((-F.col("cnt")).alias("k"), F.col("num"), F.col("value"))
    return tall.groupBy("ordinal", "column_name").agg(
        F.sum("cnt").alias("n_rows"),
        F.sum(F.when(nn, F.col("cnt")).otherwise(0)).alias("non_null"),
        F.sum(F.when(~nn, F.col("cnt")).otherwise(0)).alias("null_count"),
        F.count(F.when(nn, F.lit(1))).alias("distinct_count"),
        F.min_by(F.when(nn, F.col("value")), F.when(nn, order_key)).alias("mode"),
        F.min_by(F.when(nn, F.col("num")), F.when(nn, order_key)).alias("mode_num"),
        F.max(F.when(nn, F.col("cnt"))).alias("mode_freq"),
    )


# ---------------------------------------------------------------- B2 .. B7

def table_overview(df: DataFrame) -> DataFrame:
    """B2: rows, columns, numeric and categorical column counts."""
    r = column_roles(df)
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select(
        "n_rows",
        F.lit(len(df.columns)).cast("long").alias("n_columns"),
        F.lit(len(r.numerical)).cast("long").alias("n_numerical"),
        F.lit(len(r.categorical)).cast("long").alias("n_categorical"),
    )


def preview(df: DataFrame, order_by: Sequence[str], n: int = 10) -> DataFrame:
    """First ``n`` rows by a key (Spark tables have no row order)."""
    return df.orderBy(*all_named(order_by)).limit(n)


#: Relative error of distinct-count sketches; columns with fewer distinct values than FEW_VALUES are counted together.
SKETCH_ERROR, FEW_VALUES = 0.02, 20_000


def cell_value(df: DataFrame, name: str):
    """A column's values as they are told apart: -0.0 is 0.0, NaN is missing."""
    dt = df.schema[name].dataType
    if isinstance(dt, FLOATING_TYPES) or isinstance(dt, T.DecimalType):
        return as_double(named(name)) + F.lit(0.0)
    return named(name).cast("string") if isinstance(dt, (T.ArrayType, T.MapType, T.StructType)) else named(name)


def distinct_counts(df: DataFrame, sketched: dict[str, int]) -> dict[str, int]:
    """Exact distinct non-missing values of the columns of ``sketched`` (name -> roughly how many).

    Columns of few values share one pass over the tall profile, where a task sends each value once. A key-like
    column is deduplicated by itself and in its own type: its values are shuffled, which an exact count needs, but neither as
    text nor beside other columns' cells.
    """
    few = [c for c, n in sketched.items() if n <= FEW_VALUES]
    parts = []
    if few:
        parts.append(value_counts_tall(df, few).where("value IS NOT NULL").groupBy("column_name").agg(F.count(F.lit(1)).alias("n")))
    for c in sketched:
        if c not in few:
            values = df.select(cell_value(df, c).alias("v")).where("v IS NOT NULL").distinct()
            parts.append(values.agg(F.count(F.lit(1)).alias("n")).select(F.lit(c).alias("column_name"), "n"))
    got = {}
    if parts:
        every = parts[0]
        for p in parts[1:]:
            every = every.unionByName(p)
        got = {r["column_name"]: r["n"] for r in every.collect()}  # one row per column
    return {c: got.get(c, 0) for c in sketched}


def column_types(df: DataFrame) -> DataFrame:
    """Per column dtype label, non-null, null and distinct counts."""
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, c in enumerate(df.columns):
        v = cell_value(df, c)
        aggs += [F.count(v).alias(f"n{i}"), F.approx_count_distinct(v.cast("string"), SKETCH_ERROR).alias(f"d{i}")]
    r = df.agg(*aggs).first()
    exact = distinct_counts(df, {c: r[f"d{i}"] for i, c in enumerate(df.columns)})
    rows = [(f.name, type_name(f.dataType), r[f"n{i}"], r["n"] - r[f"n{i}"], exact[f.name]) for i, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(rows, "column_name string, dtype string, non_null_count long, null_count long, unique_count long")


def describe(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Count, mean, std (ddof=1), min, 25 %, 50 %, 75 %, max per numeric column (tall).

    Two passes: one aggregate gives the moments (one small row, kept as parameters),
    the exact quantiles are the second pass.
    """
    cols = list(cols) if cols is not None else list(column_roles(df).numerical)
    aggs = []
    for i, c in enumerate(cols):
        v = as_double(c)
        aggs += [F.count(v).alias(f"n{i}"), F.avg(v).alias(f"m{i}"), F.stddev_samp(v).alias(f"s{i}"),
                 F.min(v).alias(f"lo{i}"), F.max(v).alias(f"hi{i}")]
    r = df.agg(*aggs).collect()[0]
    rows = [(c, r[f"n{i}"], r[f"m{i}"], r[f"s{i}"], r[f"lo{i}"], r[f"hi{i}"])
            for i, c in enumerate(cols)]
    m = df.sparkSession.createDataFrame(
        rows, "column string, count long, mean double, std double, min double, max double")
    q = exact_quantiles(df, cols, [0.25, 0.5, 0.75], names=["q25", "q50", "q75"])
    out = m.join(q.select("column", "q25", "q50", "q75"), "column", "left")
    return out.select(F.col("column").alias("column_name"), "count", "mean", "std", "min",
                      "q25", "q50", "q75", "max")


def categorical_summary(df: DataFrame, cols: Sequence[str] | None = None,
                        tall: DataFrame | None = None) -> DataFrame:
    """Distinct count, mode (smallest on ties), mode frequency per string column."""
    cols = list(cols) if cols is not None else list(column_roles(df).categorical)
    tall = tall if tall is not None else value_counts_tall(df, cols)
    s = column_summary(tall.where(F.col("column_name").isin(cols)))
    return s.select("column_name", F.col("distinct_count").alias("unique_count"),
                    F.col("mode").alias("top"), F.col("mode_freq").alias("freq"))


def class_distribution(df: DataFrame, target: str) -> DataFrame:
    """Per class count (nulls dropped) and share of *all* rows in %."""
    counts = df.groupBy(named(target).alias("_cls")).agg(F.count(F.lit(1)).alias("class_count"))
    pct = F.try_divide(F.col("class_count") * 100.0, F.col("_total"))
    return (attach_row(counts, counts.agg(F.sum("class_count").alias("_total"))).select("_cls", "class_count", pct.alias("percentage"))
            .where(F.col("_cls").isNotNull())
            .select(F.col("_cls").cast("string").alias("class_value"), "class_count",
                    "percentage"))
