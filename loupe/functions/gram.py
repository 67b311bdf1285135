"""Pairwise-complete second moments of many numeric columns in one pass.

A correlation matrix over k columns needs k^2 pairwise statistics. As Spark
aggregates that is ~10 k^2 buffer fields, far past the whole-stage codegen
limit, so the aggregate runs interpreted. Instead each partition computes
masked Gram matrices with numpy (X'X, X'M, (X*X)'M, M'M on centred values,
M the non-null mask), emits k^2 partial rows, and Spark sums them per pair:
one scan, one tiny shuffle, and the per-task state is O(k^2) whatever the
row count.

Values are centred by the column means of a first (cheap, codegen'd)
aggregate, so the raw sums do not cancel catastrophically.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loupe.functions.stats import as_double

_PAIR_SCHEMA = ("i int, j int, n double, sa double, sb double, saa double, sbb double, "
                "sab double")


def _partials(k: int, means: np.ndarray):
    def run(batches):
        acc = None
        for pdf in batches:
            x = pdf.to_numpy(dtype=np.float64, na_value=np.nan)
            m = ~np.isnan(x)
            xc = np.where(m, x - means, 0.0)
            mf = m.astype(np.float64)
            blocks = (mf.T @ mf, xc.T @ mf, mf.T @ xc, (xc * xc).T @ mf, mf.T @ (xc * xc),
                      xc.T @ xc)
            acc = blocks if acc is None else tuple(a + b for a, b in zip(acc, blocks))
        if acc is None:
            return
        n, sa, sb, saa, sbb, sab = acc
        ii, jj = np.meshgrid(np.arange(k), np.arange(k), indexing="ij")
        yield pd.DataFrame({
            "i": ii.ravel().astype(np.int32), "j": jj.ravel().astype(np.int32),
            "n": n.ravel(), "sa": sa.ravel(), "sb": sb.ravel(), "saa": saa.ravel(),
            "sbb": sbb.ravel(), "sab": sab.ravel()})
    return run


def pairwise_moments(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``col_a, col_b, n, var_a, var_b, cov`` (population, pairwise-complete rows)."""
    cols = list(cols)
    k = len(cols)
    x = df.select(*[as_double(c).alias(f"c{i}") for i, c in enumerate(cols)])
    mrow = x.agg(*[F.avg(f"c{i}").alias(f"c{i}") for i in range(k)]).collect()[0]
    means = np.array([0.0 if mrow[i] is None else float(mrow[i]) for i in range(k)])
    parts = x.mapInPandas(_partials(k, means), _PAIR_SCHEMA)
    s = parts.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in
                                      ("n", "sa", "sb", "saa", "sbb", "sab")])
    names = F.array(*[F.lit(c) for c in cols])
    mu_a, mu_b = F.col("sa") / F.col("n"), F.col("sb") / F.col("n")
    return s.where(F.col("n") > 0).select(
        names[F.col("i")].alias("col_a"), names[F.col("j")].alias("col_b"), "n",
        (F.col("saa") / F.col("n") - mu_a * mu_a).alias("var_a"),
        (F.col("sbb") / F.col("n") - mu_b * mu_b).alias("var_b"),
        (F.col("sab") / F.col("n") - mu_a * mu_b).alias("cov"))


def pearson_from_moments(m: DataFrame) -> DataFrame:
    """``col_a, col_b, correlation``; NULL where a side is constant on the common rows."""
    denom = F.sqrt(F.col("var_a") * F.col("var_b"))
    # relative tolerance: a centred constant column has var ~ 1e-32 * mean^2
    r = F.when((F.col("var_a") > 0) & (F.col("var_b") > 0) & (denom > 0),
               F.col("cov") / denom)
    r = F.when(r.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)))
    return m.select("col_a", "col_b", r.alias("correlation"))
