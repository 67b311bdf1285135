"""Connected components of a large edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loupe.llm.store import written


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v: bigint), root being the smallest node reachable.

    Large-star hangs a node's larger neighbours below its smallest one, small-star does so
    with the smaller ones; the edges end as one star per component. Every round works on
    written tables, so both sides of each join are shuffled and a hub with very many
    neighbours is split by the skew-join rule; the minima are combined before their
    shuffle. Nothing but two checksums goes to the driver.
    """
    state = _checked(edges.filter("u <> v").select(F.greatest("u", "v").alias("v"), F.least("u", "v").alias("m")).distinct())
    for _ in range(max_rounds):
        now, before = state
        if not before[0]:
            break
        both = now.select(F.col("m").alias("u"), "v").unionByName(now.select(F.col("v").alias("u"), F.col("m").alias("v")))
        least = written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "star-min")
        large = both.join(least, "u").filter("v > u").select("v", "m").filter("v <> m").distinct()
        large = written(large, "large-star")
        low = written(large.groupBy("v").agg(F.min("m").alias("least")), "star-min")
        small = large.join(low, "v").select(
            F.explode(F.array(F.struct("v", F.col("least").alias("m")), F.struct(F.col("m").alias("v"), F.col("least").alias("m")))).alias("e"))
        state = _checked(small.select("e.v", "e.m").filter("v <> m").distinct())
        if state[1] == before:
            break
    else:
        raise RuntimeError(f"components: not settled after {max_rounds} rounds")
    now = state[0]
    return now.select(F.col("v").alias("node"), F.col("m").alias("root")).unionByName(
        now.select(F.col("m").alias("node"), F.col("m").alias("root")).distinct())


def _checked(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The written edges with their count and an order-free checksum."""
    out = written(edges, "edges")
    r = out.agg(F.count("*").alias("n"), F.sum(F.xxhash64("v", "m").cast("decimal(38,0)")).alias("s")).first()
    return out, (r["n"], r["s"])
