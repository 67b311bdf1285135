"""Distributed rank primitives against pandas / brute force, including a hot key."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from loupe.functions.ranks import cumulative, exact_quantiles, prefix_counts, row_ranks


def _frame(spark, n=3000, seed=1):
    rng = np.random.default_rng(seed)
    g = np.where(rng.random(n) < 0.4, "hot", rng.choice(["a", "b", "c"], n))  # one hot group
    v = np.round(rng.normal(50, 20, n), 1)
    v[rng.random(n) < 0.3] = 7.0  # a value holding ~30 % of the rows
    v[rng.random(n) < 0.05] = np.nan
    pdf = pd.DataFrame({"g": g, "v": v, "id": np.arange(n)})
    return pdf, spark.createDataFrame(pdf)


def test_quantiles_match_pandas(spark):
    pdf, df = _frame(spark)
    q = exact_quantiles(df, ["v"], [0.0, 0.25, 0.5, 0.9, 1.0], ["g"]).toPandas()
    for g, sub in pdf.groupby("g"):
        exp = sub["v"].dropna().quantile([0.0, 0.25, 0.5, 0.9, 1.0]).to_numpy()
        got = q[q.g == g][["q0", "q25", "q50", "q90", "q100"]].to_numpy()[0]
        assert np.allclose(exp, got, rtol=0, atol=1e-9), (g, exp, got)


def test_prefix_counts_positions(spark):
    pdf, df = _frame(spark)
    pc = prefix_counts(df, ["g"], "v").toPandas()
    for g, sub in pdf.groupby("g"):
        s = sub["v"].dropna()
        for _, r in pc[pc.g == g].iterrows():
            assert r["before"] == (s < r["v"]).sum()
            assert r["cnt"] == (s == r["v"]).sum()
            assert r["total"] == len(s)


def test_row_ranks_are_a_permutation_in_order(spark):
    pdf, df = _frame(spark)
    r = row_ranks(df.withColumn("h", F.md5(F.col("id").cast("string"))), ["g"], ["h", "id"]).toPandas()
    for g, sub in r.groupby("g"):
        sub = sub.sort_values(["h", "id"])
        assert list(sub["_rank"]) == list(range(len(sub)))
        assert (sub["_total"] == len(sub)).all()


def test_row_ranks_stable_across_partitionings(spark):
    _, df = _frame(spark)
    a = row_ranks(df.repartition(3), [], ["id"]).select("id", "_rank").toPandas().sort_values("id")
    b = row_ranks(df.repartition(11), [], ["id"]).select("id", "_rank").toPandas().sort_values("id")
    assert list(a["_rank"]) == list(b["_rank"]) == list(range(len(a)))


def test_cumulative_measures(spark):
    pdf = pd.DataFrame({"k": ["x"] * 6, "s": [0.1, 0.1, 0.5, 0.7, 0.7, 0.9], "y": [1, 0, 0, 1, 1, 0]})
    c = cumulative(spark.createDataFrame(pdf), ["k"], "s",
                   {"pos": F.sum("y"), "neg": F.sum(1 - F.col("y"))}).toPandas().sort_values("s")
    assert list(c["pos_before"]) == [0, 1, 1, 3]
    assert list(c["neg_before"]) == [0, 1, 2, 2]
    assert (c["pos_total"] == 3).all() and (c["neg_total"] == 3).all()


def test_fill_last_both_directions_across_slices(spark):
    from loupe.functions.ranks import fill_last
    rows = []
    for g in ("a", "b"):
        for i in range(400):
            rows.append((g, i, float(i) if i % 37 == 0 else None))
    df = spark.createDataFrame(rows, "g string, o long, v double")
    fwd = fill_last(df, ["g"], "o", "v", "prev", partitions=7).toPandas()
    bwd = fill_last(df, ["g"], "o", "v", "next", descending=True, partitions=7).toPandas()
    for g in ("a", "b"):
        f = fwd[fwd.g == g].sort_values("o")
        b = bwd[bwd.g == g].sort_values("o")
        exp_prev = [float((i // 37) * 37) for i in range(400)]
        exp_next = [float(-(-i // 37) * 37) if -(-i // 37) * 37 < 400 else None for i in range(400)]
        assert list(f["prev"]) == exp_prev
        got_next = [None if x != x else x for x in b["next"]]
        assert got_next == exp_next


def test_a_hot_value_is_spread_over_slices(spark):
    from loupe.functions.ranks import sliced
    df = spark.range(20_000).select(F.when(F.col("id") % 5 > 0, 0.0).otherwise(F.col("id").cast("double")).alias("v"))
    r = row_ranks(df, [], ["v"], partitions=16)
    assert r.agg(F.count("*"), F.countDistinct("_rank"), F.max("_rank")).first()[:] == (20_000, 20_000, 19_999)
    tied = df.withColumn("_tie", F.monotonically_increasing_id())
    sizes = [x["count"] for x in sliced(tied, [], ["v", "_tie"], 16).groupBy("_s").count().collect()]
    assert len(sizes) > 8 and max(sizes) <= 3 * sum(sizes) / len(sizes)


def test_null_groups_rank_by_themselves(spark):
    df = spark.createDataFrame([(None, 3), (None, 1), ("a", 2), ("a", 5), (None, 2)], "g string, v int")
    got = sorted((r.g or "", r.v, r._rank, r._total) for r in row_ranks(df, ["g"], ["v"]).collect())
    assert got == [("", 1, 0, 3), ("", 2, 1, 3), ("", 3, 2, 3), ("a", 2, 0, 2), ("a", 5, 1, 2)]
