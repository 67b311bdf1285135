"""Column expressions for statistics that Spark does not offer in the needed form.

All of them are JVM-side expressions (codegen, no Python in the hot path).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loupe.functions.names import all_named, named


def as_double(c: str | Column) -> Column:
    """Cast to double and turn NaN into NULL (one notion of missing)."""
    col = named(c) if isinstance(c, str) else c
    d = col.cast("double")
    return F.when(F.isnan(d), F.lit(None).cast("double")).otherwise(d)


def is_missing(df: DataFrame, c: str) -> Column:
    """NULL, or NaN in a floating column."""
    null = named(c).isNull()
    return null | F.isnan(named(c)) if isinstance(df.schema[c].dataType, (T.FloatType, T.DoubleType)) else null


def safe_corr(x: str, y: str) -> Column:
    """Pearson r over pairwise-complete rows; NULL where a side is constant.

    ``corr`` raises DIVIDE_BY_ZERO under ANSI on a constant column, so the
    ratio is taken with ``try_divide``.
    """
    cx, cy = named(x), named(y)
    both_x = F.when(cy.isNotNull(), cx)
    both_y = F.when(cx.isNotNull(), cy)
    denom = F.stddev_pop(both_x) * F.stddev_pop(both_y)
    r = F.try_divide(F.covar_pop(cx, cy), F.when(denom > 0, denom))
    # clamp rounding noise just outside [-1, 1]; greatest/least skip NULLs, so
    # the NULL of a constant column is kept explicitly
    return F.when(r.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)))


def sample_skewness(c: Column) -> Column:
    """Bias-corrected skewness G1 (as pandas ``skew``); 0 for a constant column, NULL for n<3."""
    n = F.count(c).cast("double")
    g1 = F.coalesce(F.skewness(c), F.lit(0.0))
    return F.when(n >= 3, g1 * F.sqrt(n * (n - 1)) / (n - 2))


def sample_kurtosis(c: Column) -> Column:
    """Bias-corrected excess kurtosis G2 (as pandas ``kurt``); 0 for a constant column, NULL for n<4."""
    n = F.count(c).cast("double")
    g2 = F.kurtosis(c)
    varying = F.stddev_pop(c) > 0
    g2c = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6)
    return F.when(n >= 4, F.when(varying, g2c).otherwise(F.lit(0.0)))


# Coefficients of the rational approximation of the inverse
# normal CDF (P. J. Acklam, 2003), relative error below 1.2e-9.
_A = [-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02,
      1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00]
_B = [-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02,
      6.680131188771972e01, -1.328068155288572e01]
_C = [-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00,
      -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00]
_D = [7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00,
      3.754408661907416e00]
_P_LOW = 0.02425


def _horner(coefs: list[float], x: Column) -> Column:
    acc = F.lit(coefs[0])
    for c in coefs[1:]:
        acc = acc * x + F.lit(c)
    return acc


def norm_ppf(p: Column) -> Column:
    """Inverse standard-normal CDF as a Column expression (Spark has none built in)."""
    q = p - 0.5
    r = q * q
    central = _horner(_A, r) * q / (_horner(_B, r) * r + 1.0)
    ql = F.sqrt(-2.0 * F.log(p))
    lower = _horner(_C, ql) / (_horner(_D, ql) * ql + 1.0)
    qu = F.sqrt(-2.0 * F.log(1.0 - p))
    upper = -_horner(_C, qu) / (_horner(_D, qu) * qu + 1.0)
    return (F.when(p < _P_LOW, lower)
            .when(p > 1.0 - _P_LOW, upper)
            .otherwise(central))


def round_stable(name: str, digits: int = 6, significant: int = 11) -> Column:
    """Round to ``digits`` decimals, or to ``significant`` digits for large values.

    Engines sum in different orders, so large statistics (a variance of 3e11)
    differ in the last bits; both sides of a comparison round this way. Built
    as one SQL expression (a single call into the JVM).
    """
    x = f"CAST(`{name}` AS DOUBLE)"
    branches = [f"WHEN abs({x}) < 1e{significant - digits} THEN round({x}, {digits})"]
    for e in range(significant - digits, 23):
        branches.append(f"WHEN abs({x}) < 1e{e + 1} THEN round({x}, {significant - 1 - e})")
    return F.expr(f"CASE {' '.join(branches)} ELSE {x} END")


def round_doubles(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double/float column (used for engine-independent comparison)."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append(round_stable(f.name, digits).alias(f.name))
        else:
            cols.append(named(f.name))
    return df.select(*all_named(cols))
