"""Fitted transforms on streaming DataFrames.

The reference has no streams. What carries over is that every ``apply``
step of :mod:`loupe.operators.prep` and :mod:`loupe.operators.scale` is a
pure Column expression with parameters fitted on a batch table, so the same
parameters clean a ``readStream`` DataFrame row by row, without state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from loupe.operators import prep as P
from loupe.operators import scale as S


def apply_fitted(df: DataFrame, params: dict) -> DataFrame:
    """Apply every fitted step of ``Prepared.params`` to new rows, in the order of ``prepare``.

    Works for batch and streaming DataFrames alike: all but label dictionaries are literals
    inside Column expressions, and a dictionary is a static table joined to the stream.
    Steps that remove rows (duplicates, outliers) concern the training table only.
    """
    if "drop" in params:
        df = P.drop_columns(df, params["drop"])
    if "other" in params:
        df, _ = P.expand_other(df, exclude=[c for c in df.columns if c not in params["other"]])
    if "impute" in params:
        df = _filled(df, params["impute"])
    if "cap" in params:
        df = P.cap_outliers(df, params["cap"])
    if "frequent" in params:
        df = P.apply_group_rare(df, params["frequent"])
    if "auto_impute" in params:
        df = _filled(df, params["auto_impute"])
    if "one_hot" in params:
        df = P.apply_one_hot(df, params["one_hot"])
    for c, dictionary in params.get("labels", {}).items():
        df = P.apply_label_encoding(df, c, dictionary)
    if "scale" in params:
        kind, fitted = params["scale"]
        df = (S.apply_standard if kind == "standard" else S.apply_minmax)(df, fitted)
    return df


def _filled(df: DataFrame, fills: dict) -> DataFrame:
    num = {c: v for c, v in fills.items() if isinstance(v, float) and c in df.columns}
    cat = {c: v for c, v in fills.items() if isinstance(v, str) and c in df.columns}
    return P.apply_categorical_imputer(P.apply_numeric_imputer(df, num, list(num)), cat)
