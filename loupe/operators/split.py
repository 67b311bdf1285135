"""Deterministic train/test splits, undersampling and CV folds.

Rows are ordered inside each class by ``md5(key || ':' || seed)``; the
first ``quota`` rows of a class go to the test set. Ranks come from the
range-partitioned :func:`loupe.functions.ranks.row_ranks`, so the majority
class is spread over many tasks instead of one window partition. The same
order is expressible in SQL, which gives exact twins.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loupe.functions.names import all_named, named
from loupe.functions.ranks import row_ranks
from loupe.session import attach_row, join_small


def hash_order(key: Sequence[str], seed: int = 42) -> Column:
    parts = [named(k).cast("string") for k in key]
    base = parts[0] if len(parts) == 1 else F.concat_ws("-", *parts)
    return F.md5(F.concat(base, F.lit(f":{seed}")))


def class_quotas(df: DataFrame, label: str, test_size: float = 0.2) -> DataFrame:
    """Per class ``n_class, n_test``: largest-remainder allocation of the train rows.

    n_test = ceil(t * n) overall; train rows n - n_test are shared by
    floor(n_train * n_c / n) plus one for the largest remainders (ties by
    class value); each class's test count is the rest.
    """
    c = df.groupBy(named(label)).agg(F.count(F.lit(1)).alias("n_class"))
    allc = Window.partitionBy()
    n = F.sum("n_class").over(allc)
    c = c.select("*", n.alias("_n"))
    n_test = F.ceil(F.lit(float(test_size)) * F.col("_n"))
    c = c.select("*", (F.col("_n") - n_test).alias("_ntrain"))
    exact = F.col("_ntrain") * F.col("n_class") / F.col("_n")
    c = c.select("*", F.floor(exact).alias("_fl"), (exact - F.floor(exact)).alias("_rem"))
    left = F.col("_ntrain") - F.sum("_fl").over(allc)
    order = Window.partitionBy().orderBy(F.col("_rem").desc(), named(label))
    c = c.select("*", left.alias("_left"), F.row_number().over(order).alias("_ro"))
    train = F.col("_fl") + F.when(F.col("_ro") <= F.col("_left"), 1).otherwise(0)
    return c.select(named(label), "n_class", (F.col("n_class") - train).cast("long").alias("n_test"))


def stratified_split(df: DataFrame, label: str, key: Sequence[str], test_size: float = 0.2,
                     seed: int = 42, split_col: str = "split") -> DataFrame:
    """Every row with ``split`` in {train, test}; class shares kept.

    The quota table has one row per class; it is broadcast after its rows are counted, so
    the facts are not shuffled by label.
    """
    q = class_quotas(df, label, test_size)
    r = row_ranks(df.withColumn("_h", hash_order(key, seed)), [label], ["_h", *key])
    j = join_small(r, q.select(named(label), "n_test"), [label])
    s = F.when(F.col("_rank") < F.col("n_test"), F.lit("test")).otherwise(F.lit("train"))
    return j.select(*all_named(df.columns), s.alias(split_col))


def random_split(df: DataFrame, key: Sequence[str], test_size: float = 0.2, seed: int = 42,
                 split_col: str = "split") -> DataFrame:
    """The first ceil(t * n) rows in hash order are the test set."""
    r = row_ranks(df.withColumn("_h", hash_order(key, seed)), [], ["_h", *key])
    n_test = F.ceil(F.lit(float(test_size)) * F.col("_total"))
    s = F.when(F.col("_rank") < n_test, F.lit("test")).otherwise(F.lit("train"))
    return r.select(*all_named(df.columns), s.alias(split_col))


def split(df: DataFrame, label: str, key: Sequence[str], test_size: float = 0.2,
          seed: int = 42) -> DataFrame:
    """Stratified when every class has at least two rows and neither part has fewer rows
    than there are classes, else plain (E14 | E15)."""
    r = df.groupBy(named(label)).count().agg(F.min("count").alias("least"), F.count(F.lit(1)).alias("k"),
                                      F.sum("count").alias("n")).first()
    n_test = math.ceil(test_size * (r["n"] or 0))
    if r["least"] is not None and r["least"] >= 2 and min(n_test, r["n"] - n_test) >= r["k"]:
        return stratified_split(df, label, key, test_size, seed)
    return random_split(df, key, test_size, seed)


def undersample(df: DataFrame, label: str, key: Sequence[str], seed: int = 42) -> DataFrame:
    """Keep the first ``min class count`` rows of every class in hash order."""
    r = row_ranks(df.withColumn("_h", hash_order(key, seed)), [label], ["_h", *key])
    m = df.groupBy(named(label)).count()
    m = attach_row(m, m.agg(F.min("count").alias("_m"))).drop("count")
    j = join_small(r, m, [label])
    return j.where(F.col("_rank") < F.col("_m")).select(*all_named(df.columns))


def cv_folds(df: DataFrame, label: str, key: Sequence[str], k: int, seed: int = 42,
             fold_col: str = "fold") -> DataFrame:
    """stratified fold id = rank inside the class (hash order) modulo k."""
    r = row_ranks(df.withColumn("_h", hash_order(key, seed)), [label], ["_h", *key])
    return r.select(*all_named(df.columns), (F.col("_rank") % k).cast("int").alias(fold_col))


def fold_count(df: DataFrame, label: str, default: int = 5, cap: int = 10) -> DataFrame:
    """``max_folds = min(10, smallest class)``, ``folds = min(5, max)``, search flag."""
    m = df.groupBy(named(label)).count().agg(F.min("count").alias("min_class_count"))
    mx = F.least(F.lit(cap).cast("long"), F.col("min_class_count"))
    return m.select("min_class_count", mx.alias("max_folds"),
                    F.when(mx < 2, F.lit(2).cast("long")).otherwise(F.least(F.lit(default).cast("long"), mx))
                    .alias("folds"),
                    (mx >= 2).alias("search_enabled"))
