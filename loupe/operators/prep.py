"""Cleaning and encoding.

Each step is ``fit(df, ...) -> params`` (small: one value per column, or a
bounded category list) and ``apply(df, params) -> DataFrame`` (Column
expressions only, so it stays in whole-stage codegen and also runs on
streaming DataFrames). Steps whose parameters grow with the data (label
dictionaries) stay DataFrames and are joined back.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loupe.functions.names import all_named, named
from loupe.functions.ranks import exact_quantiles, row_ranks
from loupe.functions.roles import column_roles
from loupe.functions.stats import as_double, is_missing
from loupe.session import attach_row, join_small, materialize
from loupe.operators.profile import column_summary, value_counts_tall

# The reference's defaults.
RARE_THRESHOLD = 0.05
OTHER = "Other"
UNKNOWN = "Unknown"
MIN_ROWS = 10


@dataclass(frozen=True)
class PrepConfig:
    """The user's preprocessing decisions."""

    remove_duplicates: bool = True
    remove_constant_features: bool = True
    fix_missing_values: bool = True
    numerical_strategy: str = "median"          # mean | median | most_frequent
    categorical_strategy: str = "most_frequent"  # most_frequent | constant
    outlier_handling: str = "keep"              # keep | cap | remove
    fix_high_cardinality: bool = False
    cardinality_threshold: float = RARE_THRESHOLD
    encoding: str = "onehot"                    # onehot | label
    test_size: float = 0.2
    imbalance_handling: str = "none"            # none | smote | undersample | class_weights
    scaling: str = "standard"                   # standard | minmax | none
    seed: int = 42

    def __post_init__(self):
        """Refuses option values that no step knows."""
        known = {"numerical_strategy": ("mean", "median", "most_frequent"), "categorical_strategy": ("most_frequent", "constant"),
                 "outlier_handling": ("keep", "cap", "remove"), "encoding": ("onehot", "label"),
                 "imbalance_handling": ("none", "smote", "undersample", "class_weights"), "scaling": ("standard", "minmax", "none")}
        for name, values in known.items():
            if getattr(self, name) not in values:
                raise ValueError(f"{name}={getattr(self, name)!r}: one of {', '.join(values)} is expected")
        if not 0 < self.test_size < 1:
            raise ValueError(f"test_size={self.test_size!r}: a share between 0 and 1 is expected")


# ---------------------------------------------------------------- E1, E2

def drop_duplicates(df: DataFrame) -> DataFrame:
    """Keep one row of each group of identical rows (NULLs equal)."""
    return df.dropDuplicates()


def drop_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Drop the flagged constant columns that are present."""
    return df.drop(*[c for c in cols if c in df.columns])


# ---------------------------------------------------------------- E4, E5, E9 imputation

def fit_numeric_imputer(df: DataFrame, cols: Sequence[str], strategy: str = "median") -> dict:
    """One fill value per column from all rows (mean | median | most_frequent).

    The result is one small row per column; columns without any value get no
    fill value.
    """
    cols = list(cols)
    if not cols:
        return {}
    if strategy == "mean":
        row = df.agg(*[F.avg(as_double(c)).alias(c) for c in cols]).collect()[0]
        vals = {c: row[c] for c in cols}
    elif strategy == "median":
        q = exact_quantiles(df, cols, [0.5], names=["median"]).collect()
        vals = {r["column"]: r["median"] for r in q}
    elif strategy == "most_frequent":
        s = column_summary(value_counts_tall(df, cols)).select("column_name", "mode_num").collect()
        vals = {r["column_name"]: r["mode_num"] for r in s}
    else:
        raise ValueError(f"unknown numeric strategy {strategy!r}")
    return {c: float(v) for c, v in vals.items() if v is not None}


def fit_categorical_imputer(df: DataFrame, cols: Sequence[str],
                            strategy: str = "most_frequent") -> dict:
    """E5: most frequent value (smallest on ties) or the constant ``Unknown``."""
    cols = list(cols)
    if not cols:
        return {}
    if strategy == "constant":
        return {c: UNKNOWN for c in cols}
    if strategy != "most_frequent":
        raise ValueError(f"unknown categorical strategy {strategy!r}")
    s = column_summary(value_counts_tall(df, cols)).select("column_name", "mode").collect()
    return {r["column_name"]: r["mode"] for r in s if r["mode"] is not None}


def apply_numeric_imputer(df: DataFrame, fills: dict, cols: Sequence[str] | None = None) -> DataFrame:
    """Fill NULL/NaN; imputed numeric columns become double (as a fitted imputer returns)."""
    cols = list(cols) if cols is not None else list(fills)
    out = []
    for c in df.columns:
        if c in cols:
            v = fills.get(c)
            e = as_double(c) if v is None else F.coalesce(as_double(c), F.lit(float(v)))
            out.append(e.alias(c))
        else:
            out.append(named(c))
    return df.select(*out)


def apply_categorical_imputer(df: DataFrame, fills: dict) -> DataFrame:
    return df.select(*[F.coalesce(named(c), F.lit(fills[c])).alias(c) if c in fills else named(c)
                       for c in df.columns])


def auto_impute(df: DataFrame, exclude: Sequence[str] = ()) -> tuple[DataFrame, dict]:
    """Safety imputation before encoding — median for numbers, mode for strings.

    Only columns that still hold nulls are touched.
    """
    roles = column_roles(df, exclude=list(exclude))
    cols = [*roles.numerical, *roles.categorical]
    row = df.agg(*[F.max(is_missing(df, c)).alias(c) for c in cols]).first().asDict() if cols else {}
    nulls = {c for c in cols if row[c]}
    num = [c for c in roles.numerical if c in nulls]
    cat = [c for c in roles.categorical if c in nulls]
    nf = fit_numeric_imputer(df, num, "median")
    cf = fit_categorical_imputer(df, cat, "most_frequent")
    out = apply_categorical_imputer(apply_numeric_imputer(df, nf, num), cf)
    return out, {**nf, **cf}


# ---------------------------------------------------------------- E6, E7 outliers

def cap_outliers(df: DataFrame, bounds: dict) -> DataFrame:
    """Clip to ``{col: (lo, hi)}``; NULL stays NULL (``greatest``/``least`` would not)."""
    out = []
    for c in df.columns:
        if c in bounds:
            lo, hi = bounds[c]
            x = as_double(c)  # a NaN is missing, not above the upper bound
            out.append(F.when(x < lo, F.lit(lo)).when(x > hi, F.lit(hi)).otherwise(x).alias(c))
        else:
            out.append(named(c))
    return df.select(*out)


def remove_outliers(df: DataFrame, bounds: dict) -> DataFrame:
    """Keep rows inside every bound; a NULL in a checked column drops the row."""
    present = {c: b for c, b in bounds.items() if c in df.columns}
    if not present:
        return df
    cond = None
    for c, (lo, hi) in present.items():
        ok = F.coalesce((as_double(c) >= lo) & (as_double(c) <= hi), F.lit(False))
        cond = ok if cond is None else cond & ok
    return df.where(cond)


def bounds_of(outliers: DataFrame) -> dict:
    """``{column: (lower, upper)}`` from a D2 result (one row per flagged column)."""
    return {r["column_name"]: (float(r["lower_bound"]), float(r["upper_bound"]))
            for r in outliers.select("column_name", "lower_bound", "upper_bound").collect()}


# ---------------------------------------------------------------- E8 rare categories

def fit_frequent_values(df: DataFrame, cols: Sequence[str], threshold: float = RARE_THRESHOLD) -> dict:
    """E8 fit: per column the values whose share of non-null values is >= threshold.

    At most ``1/threshold`` values per column qualify, so the kept list has a
    proven size bound however many distinct values the column has.
    """
    cols = list(cols)
    if not cols:
        return {}
    tall = value_counts_tall(df, cols).where(F.col("value").isNotNull())
    # per-column totals: one row per column, broadcast (no window over all values)
    totals = tall.groupBy("column_name").agg(F.sum("cnt").alias("_nn"))
    share = F.col("cnt") / F.col("_nn")
    keep = tall.join(F.broadcast(totals), "column_name") \
        .select("column_name", "value", share.alias("share")) \
        .where(F.col("share") >= threshold).collect()
    out: dict[str, list[str]] = {c: [] for c in cols}
    for r in keep:
        out[r["column_name"]].append(r["value"])
    return out


def apply_group_rare(df: DataFrame, frequent: dict, other: str = OTHER) -> DataFrame:
    """E8 apply: non-null values outside the frequent list become ``Other``."""
    out = []
    for c in df.columns:
        if c in frequent:
            keep = named(c).isNull() | named(c).isin(frequent[c]) if frequent[c] else named(c).isNull()
            out.append(F.when(keep, named(c)).otherwise(F.lit(other)).alias(c))
        else:
            out.append(named(c))
    return df.select(*out)


# ---------------------------------------------------------------- E10 - E12 encoding

#: Columns that one-hot encoding may make in all; the result is a plan of as many expressions.
ONE_HOT_LIMIT = 5_000


def fit_one_hot(df: DataFrame, cols: Sequence[str], limit: int = ONE_HOT_LIMIT) -> dict:
    """E10 fit: sorted categories per column (the user chose to expand these columns).

    More than ``limit`` categories in all are refused with the counts by column, since each becomes an expression of
    the plan: :func:`fit_one_hot_sparse` has no limit.
    """
    cols = list(cols)
    if not cols:
        return {}
    tall = value_counts_tall(df, cols).where(F.col("value").isNotNull())
    rows = tall.select("column_name", "value").limit(limit + 1).collect()
    if len(rows) > limit:
        n = {r["column_name"]: r["count"] for r in tall.groupBy("column_name").count().collect()}
        raise ValueError(f"one-hot encoding would need over {limit} columns; categories by column: {n}")
    cats: dict[str, list[str]] = {c: [] for c in cols}
    for r in rows:
        cats[r["column_name"]].append(r["value"])
    return {c: sorted(v) for c, v in cats.items()}


def apply_one_hot(df: DataFrame, categories: dict, drop_first: bool = True) -> DataFrame:
    """E10 apply: ``{col}_{value}`` 0/1 columns in place of each column; first category dropped."""
    out = []
    for c in df.columns:
        if c in categories:
            vals = categories[c][1:] if drop_first else categories[c]
            for v in vals:
                out.append(F.coalesce((named(c) == F.lit(v)).cast("int"), F.lit(0))
                           .alias(f"{c}_{v}"))
        else:
            out.append(named(c))
    return df.select(*out)


@dataclass(frozen=True)
class OneHot:
    """Fitted sparse one-hot codes: ``dictionary`` (column_name, value, code), codes 0 .. of the categories but the first, and the number of codes by column."""
    dictionary: DataFrame
    sizes: dict[str, int]

    @property
    def offsets(self) -> dict[str, int]:
        """Where each column's codes begin in the vector."""
        out, at = {}, 0
        for c, n in self.sizes.items():
            out[c] = at
            at += n
        return out


def fit_one_hot_sparse(df: DataFrame, cols: Sequence[str]) -> OneHot:
    """E10 fit without a limit: categories are ranked in sorted order over slices, no column gathers its categories anywhere."""
    cols = list(cols)
    values = value_counts_tall(df, cols).where(F.col("value").isNotNull()).select("column_name", "value")
    ranked = materialize(row_ranks(values, ["column_name"], ["value"]))
    n = {r["column_name"]: r["n"] for r in ranked.groupBy("column_name").agg(F.max("_total").alias("n")).collect()}
    codes = ranked.where("_rank > 0").select("column_name", "value", (F.col("_rank") - 1).cast("int").alias("code"))
    return OneHot(codes, {c: max(0, n.get(c, 0) - 1) for c in cols})


def apply_one_hot_sparse(df: DataFrame, fitted: OneHot, out: str = "one_hot") -> DataFrame:
    """E10 apply: the array ``out`` of the positions that are 1, over all columns in their order, in place of the columns.

    The first category, a missing value and one the fit has not seen have no entry. A column's dictionary is joined as
    label codes are: up to 100,000 values are broadcast, more are joined by shuffling both sides.
    """
    kept, j, at = [c for c in df.columns if c not in fitted.sizes], df, fitted.offsets
    for i, c in enumerate(fitted.sizes):
        codes = fitted.dictionary.where(F.col("column_name") == c).select(F.col("value").alias("_lv"), (F.col("code") + at[c]).alias(f"_code{i}"))
        j = join_small(j.withColumn("_lv", named(c).cast("string")), codes, ["_lv"], "left", limit=100_000).drop("_lv")
    places = F.array_compact(F.array(*[F.col(f"_code{i}") for i in range(len(fitted.sizes))]))
    return j.select(*all_named(kept), places.alias(out))


def label_dictionary(df: DataFrame, col: str, null_as: str | None = "nan") -> DataFrame:
    """E11 fit: ``value -> code`` with codes = rank in sorted order (0-based).

    Distinct values are ranked by the range-partitioned ``row_ranks``, so a
    key-like column with millions of values never sits in one task.
    """
    v = named(col).cast("string")
    if null_as is not None:
        v = F.coalesce(v, F.lit(null_as))
    d = df.select(v.alias("value")).distinct()
    return row_ranks(d, [], ["value"]).select("value", F.col("_rank").cast("long").alias("code"))


def apply_label_encoding(df: DataFrame, col: str, dictionary: DataFrame,
                         null_as: str | None = "nan", out: str | None = None) -> DataFrame:
    """E11 apply: replace the strings by their codes.

    A dictionary of up to 100,000 values is broadcast after it is counted; with a larger one
    both sides are shuffled, where a hot value can be split.
    """
    out = out or col
    v = named(col).cast("string")
    if null_as is not None:
        v = F.coalesce(v, F.lit(null_as))
    keyed = df.withColumn("_lv", v)
    j = join_small(keyed, dictionary.withColumnRenamed("value", "_lv"), ["_lv"], "left", limit=100_000)
    if out == col:
        cols = [F.col("code").alias(out) if c == col else named(c) for c in df.columns]
    else:
        cols = [named(c) for c in df.columns] + [F.col("code").alias(out)]
    return j.select(*all_named(cols))


def expand_other(df: DataFrame, exclude: Sequence[str] = ()) -> tuple[DataFrame, dict]:
    """Columns that are neither numbers nor strings, as numbers: booleans 0/1, dates and
    timestamps in days since 1970; nested and binary columns are left out. Returns the
    table and what became of each such column."""
    others = set(column_roles(df, exclude=list(exclude)).other)
    out, done = [], {}
    for f in df.schema.fields:
        c, kind = named(f.name), f.dataType.typeName()
        if f.name not in others:
            out.append(c)
        elif kind == "boolean":
            out.append(c.cast("int").alias(f.name))
            done[f.name] = "0/1"
        elif kind in ("date", "timestamp", "timestamp_ntz"):
            seconds = F.unix_seconds(c.cast("timestamp"))
            out.append((seconds / 86400.0).alias(f.name))
            done[f.name] = "days"
        else:
            done[f.name] = "left out"
    return df.select(*out), done


def label_encode(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    for c in cols:
        df = apply_label_encoding(df, c, label_dictionary(df, c))
    return df


# ---------------------------------------------------------------- E13 guards

def check_trainable(df: DataFrame, label: str) -> None:
    """At least 10 rows; every class that occurs has rows (always true when counted)."""
    n = df.limit(MIN_ROWS).count()
    if n < MIN_ROWS:
        raise ValueError(f"{n} rows are left, {MIN_ROWS} are needed to train: relax the cleaning options")


# ---------------------------------------------------------------- E21 train class table

def class_table(df: DataFrame, label: str, digits: int = 2) -> DataFrame:
    """Class, count, % of rows (2 dp)."""
    g = df.groupBy(named(label).alias("class_value")).agg(F.count(F.lit(1)).alias("count"))
    j = attach_row(g, g.agg(F.sum("count").alias("_total")))
    return j.select(F.col("class_value").cast("string").alias("class_value"), "count",
                    F.round(F.col("count") * 100.0 / F.col("_total"), digits).alias("percentage"))
