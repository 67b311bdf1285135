"""Views over the driver tables used by the query catalog.

The driver tables hold no nulls and no duplicate rows, so the quality
operators run on derived "dirty" views whose defects are planted by key
arithmetic over the *whole* table (every row is kept; keys only decide which
cells are blanked or scaled and which rows are copied).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loupe.sources.tables import load


def dirty_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with planted nulls, outliers, constants, a rare status and 2 % copied rows."""
    o = load(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    b = o.select(
        "o_orderkey", "o_custkey",
        F.when(k % 17 == 0, F.lit(None).cast("double"))
         .when(k % 97 == 0, F.col("o_totalprice") * 20.0)
         .otherwise(F.col("o_totalprice")).alias("price"),
        F.when(k % 23 == 0, F.lit(None).cast("double"))
         .otherwise((F.col("o_custkey") % 40).cast("double")).alias("tenure"),
        F.when(k % 13 == 0, F.lit(None).cast("string"))
         .otherwise(F.col("o_orderpriority")).alias("priority"),
        F.concat(F.lit("city_"), (F.col("o_custkey") % 50).cast("string")).alias("city"),
        F.lit(1.0).alias("const_num"),
        F.lit("same").alias("const_str"),
        F.when(k % 400 == 0, F.lit("Inactive")).otherwise(F.lit("Active")).alias("status"),
        F.when(k % 9 == 0, F.lit(1)).otherwise(F.lit(0)).alias("target"),
    )
    return b.unionByName(b.where(k % 50 == 0))


def nan_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key, price and tenure of dirty_orders with NaN prices at keys divisible by 11."""
    d = dirty_orders(spark, sf_dir)
    nan = F.when(F.col("o_orderkey") % 11 == 0, F.lit(float("nan"))).otherwise(F.col("price"))
    return d.select("o_orderkey", nan.alias("price"), "tenure")


def _hash_digit(key, salt: str | None = None):
    """0..9 from the first hex digit of md5(key[salt]) — identical in Spark and DuckDB."""
    s = key.cast("string")
    if salt is not None:
        s = F.concat(s, F.lit(salt))
    return (F.ascii(F.substring(F.md5(s), 1, 1)) % 10).cast("double")


# Planted lift of the two hash-made binary models.
BINARY_MODELS = (("m1", 0.4), ("m2", 0.1))


def preds_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``model, row_id, label, score, prediction, segment`` — two models over all events."""
    e = load(spark, sf_dir, "events")
    label = F.when(F.col("value") > 60, F.lit(1)).otherwise(F.lit(0))
    models = F.array(*[F.struct(F.lit(m).alias("model"), F.lit(float(l)).alias("lift"))
                       for m, l in BINARY_MODELS])
    x = e.select(F.col("event_id").alias("row_id"), label.alias("label"),
                 F.col("event_type").alias("segment"), F.explode(models).alias("_m"))
    digit = (F.ascii(F.substring(F.md5(F.concat(F.col("row_id").cast("string"),
                                                F.col("_m.model"))), 1, 1)) % 10).cast("double")
    score = digit / 10.0 * 0.5 + F.when(F.col("label") == 1, F.col("_m.lift")).otherwise(0.0)
    s = F.round(score, 6)
    return x.select(F.col("_m.model").alias("model"), "row_id", "label", s.alias("score"),
                    F.when(s >= 0.5, F.lit(1)).otherwise(F.lit(0)).alias("prediction"),
                    "segment")


def preds_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``row_id, label, prediction, p0, p1, p2`` — 3-class predictions over all embeddings.

    Class scores: ``(digit_k + 1)/10`` plus 1 for the predicted class, divided
    by their sum, where ``digit_k`` hashes ``row_id || ':' || k``.
    """
    e = load(spark, sf_dir, "embeddings")
    rid = F.col("vec_id")
    label = (F.col("label") % 3).cast("int")
    flip = F.ascii(F.substring(F.md5(rid.cast("string")), 1, 1)) % 4 == 0
    pred = F.when(flip, (F.col("label") + 1) % 3).otherwise(F.col("label") % 3).cast("int")
    base = e.select(rid.alias("row_id"), label.alias("label"), pred.alias("prediction"))
    raw = [(_hash_digit(F.col("row_id"), f":{k}") + 1.0) / 10.0
           + F.when(F.col("prediction") == k, F.lit(1.0)).otherwise(F.lit(0.0)) for k in range(3)]
    total = raw[0] + raw[1] + raw[2]
    return base.select("row_id", "label", "prediction",
                       *[F.round(raw[k] / total, 6).alias(f"p{k}") for k in range(3)])


# (l_orderkey, l_linenumber) repeats in the driver data; with part and supplier it is unique
LINEITEM_KEY = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


def planted_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lineitem features with a planted rule label and a deterministic 20 % hold-out."""
    li = load(spark, sf_dir, "lineitem")
    label = F.when((F.col("l_quantity") > 25) & (F.col("l_discount") > 0.04), 1).otherwise(0)
    return li.select(
        F.concat_ws("-", *[F.col(c).cast("string") for c in LINEITEM_KEY]).alias("row_key"),
        "l_quantity", "l_discount", "l_tax", "l_extendedprice",
        label.cast("int").alias("label"),
        F.when(F.col("l_orderkey") % 5 == 0, F.lit("test")).otherwise(F.lit("train")).alias("split"),
    )
