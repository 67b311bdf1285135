"""A2: the driver's Parquet tables."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loupe.functions.names import named

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def path_of(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one table; column pruning and filters reach the Parquet scan.

    The scan's splits follow the files' row groups and the session's split size. NaN in
    floating columns becomes NULL: missing has one form from here on.
    """
    if name not in TABLES:
        raise KeyError(f"unknown table {name!r}")
    return nan_to_null(spark.read.parquet(path_of(sf_dir, name)))


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN as NULL in float and double columns."""
    floats = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))}
    if not floats:
        return df
    return df.select(*[F.nanvl(named(c), F.lit(None).cast(df.schema[c].dataType)).alias(c) if c in floats else named(c)
                       for c in df.columns])
