"""Written tables in the shared folder that the cluster names in ``spark.checkpoint.dir``."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loupe.session import checkpoint_dir


def shared_path(spark: SparkSession, what: str) -> str:
    """A fresh path below the session's checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    Cuts the lineage like ``checkpoint()`` does and survives a lost executor; unlike a
    checkpoint the table forgets its partitioning, so that a later join shuffles both
    sides and a hot key can be split by the skew-join rule.
    """
    path = shared_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, base: str) -> str:
    """``base``, with underscores in front until no column of ``df`` is called so."""
    while base in df.columns:
        base = f"_{base}"
    return base


def repeated_keys(rows: DataFrame, keys: list[str]) -> DataFrame | None:
    """The (never null) keys that occur more than once in ``rows``, written; None if there are none.

    Only the keys are shuffled, summed per task first.
    """
    again = written(rows.groupBy(*keys).count().filter("count > 1").drop("count"), "repeated-keys")
    return None if again.isEmpty() else again


def one_of_each(rows: DataFrame, keys: list[str], again: DataFrame | None) -> DataFrame:
    """``rows`` with one row of each key that ``again`` (of :func:`repeated_keys`) names; the others are not regrouped."""
    if again is None:
        return rows
    whole = F.struct(*[F.col(f"`{c}`") for c in rows.columns])
    one = rows.join(again, keys, "left_semi").groupBy(*keys).agg(F.first(whole).alias("_whole")).select("_whole.*")
    return rows.join(again, keys, "left_anti").select(*[F.col(f"`{c}`") for c in rows.columns]).unionByName(one)
