"""Exact order statistics without a single-task window.

A global ``Window.orderBy`` (or one window partition per column) moves every
value of a group into one task. Here ranks are computed the way a
distributed sort does it:

1. (for counts) collapse to distinct ``(keys, value) -> cnt`` with map-side
   combine, so a hot value holding a third of the rows is one row; row ranks add
   the row's number to the order, so equal rows may fall into several slices;
2. range-partition by ``(keys, order)`` and write the table with its partition number
   as the slice id: the ids are data from then on, whatever is recomputed or retried
   later. Spark samples the bounds and searches them; the number of slices follows
   ``spark.sql.shuffle.partitions`` and no expression grows with it;
3. running sums inside each ``(keys, slice)`` window partition, plus a tiny
   table of slice totals (slices x groups rows) turned into offsets and joined back
   on the same key, which needs no second shuffle of the rows. The group key is one
   struct column, in which nulls compare equal.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loupe.functions.names import all_named, named
from loupe.session import join_small, materialize


def sliced(df: DataFrame, keys: Sequence[str], order_cols: Sequence[str], partitions: int | None = None) -> DataFrame:
    """``df`` written in ``(keys, order)`` ranges, with the slice id ``_s`` and the group key ``_k``."""
    by = [named(c) for c in (*keys, *order_cols)]
    parts = df.repartitionByRange(partitions, *by) if partitions else df.repartitionByRange(*by)
    out = materialize(parts.withColumn("_s", F.spark_partition_id()))
    return out.withColumn("_k", _group_key(keys))


def _group_key(keys: Sequence[str]):
    return F.struct(*[named(k) for k in keys]) if keys else F.struct(F.lit(0).alias("all"))


def prefix_counts(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    weight: str | None = None,
    partitions: int | None = None,
) -> DataFrame:
    """Distinct ``(keys, order)`` rows with counts and cumulative positions.

    Output columns: ``keys..., order, cnt, before, total`` where ``before`` is
    the summed count of rows of the same key with a smaller ``order`` value
    and ``total`` the summed count of the key. Rows whose keys or order value
    are NULL are dropped.
    """
    keys = list(keys)
    measure = F.sum(named(weight)) if weight else F.count(F.lit(1))
    cond = F.lit(True)
    for c in [*keys, order]:
        cond = cond & named(c).isNotNull()
    g = sliced(df.where(cond).groupBy(*all_named(keys), order).agg(measure.alias("cnt")), keys, [order], partitions)
    w_local = (Window.partitionBy("_k", "_s").orderBy(order)
               .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    local = g.withColumn("_run", F.sum("cnt").over(w_local))
    slices = g.groupBy("_k", "_s").agg(F.sum("cnt").alias("_ptot"))
    w_off = (Window.partitionBy("_k").orderBy("_s")
             .rowsBetween(Window.unboundedPreceding, -1))
    offsets = slices.select(
        "_k", "_s",
        F.coalesce(F.sum("_ptot").over(w_off), F.lit(0)).alias("_off"),
        F.sum("_ptot").over(Window.partitionBy("_k")).alias("total"),
    )
    out = local.join(offsets, ["_k", "_s"])
    return out.select(
        *keys, order, "cnt",
        (F.col("_off") + F.col("_run") - F.col("cnt")).alias("before"),
        "total",
    )


def cumulative(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    measures: dict,
    partitions: int | None = None,
) -> DataFrame:
    """Per distinct ``(keys, order)``: each measure and its sum over smaller orders.

    ``measures`` maps output names to aggregate Columns (e.g. positives and
    negatives at a score). Output: ``keys..., order, m..., m_before...,
    m_total...``. Same slicing scheme as :func:`prefix_counts`.
    """
    keys = list(keys)
    names = list(measures)
    cond = F.lit(True)
    for c in [*keys, order]:
        cond = cond & named(c).isNotNull()
    g = sliced(df.where(cond).groupBy(*all_named(keys), order).agg(*[m.alias(n) for n, m in measures.items()]), keys, [order], partitions)
    w_local = (Window.partitionBy("_k", "_s").orderBy(order)
               .rowsBetween(Window.unboundedPreceding, -1))
    local = g.select("*", *[F.coalesce(F.sum(n).over(w_local), F.lit(0)).alias(f"_r_{n}")
                            for n in names])
    slices = g.groupBy("_k", "_s").agg(*[F.sum(n).alias(f"_p_{n}") for n in names])
    w_off = (Window.partitionBy("_k").orderBy("_s")
             .rowsBetween(Window.unboundedPreceding, -1))
    whole = Window.partitionBy("_k")
    offsets = slices.select(
        "_k", "_s",
        *[F.coalesce(F.sum(f"_p_{n}").over(w_off), F.lit(0)).alias(f"_o_{n}") for n in names],
        *[F.sum(f"_p_{n}").over(whole).alias(f"{n}_total") for n in names])
    out = local.join(offsets, ["_k", "_s"])
    return out.select(*all_named(keys), order, *names,
                      *[(F.col(f"_o_{n}") + F.col(f"_r_{n}")).alias(f"{n}_before") for n in names],
                      *[f"{n}_total" for n in names])


def fill_last(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    value: str,
    out: str,
    descending: bool = False,
    partitions: int | None = None,
) -> DataFrame:
    """As-of fill: ``out`` = the last non-null ``value`` at or before each row in
    ``order`` (at or after it when ``descending``), within ``keys``.

    Windows run per ``(keys, slice)``; the value carried into a slice comes
    from a slices x groups table of each slice's last non-null value.
    """
    keys = list(keys)
    d = sliced(df, keys, [order], partitions)
    o = named(order).desc() if descending else named(order).asc()
    so = F.col("_s").desc() if descending else F.col("_s").asc()
    w = Window.partitionBy("_k", "_s").orderBy(o).rowsBetween(Window.unboundedPreceding, 0)
    local = d.withColumn("_loc", F.last(named(value), True).over(w))
    tail = d.groupBy("_k", "_s").agg(
        (F.min_by if descending else F.max_by)(named(value), F.when(named(value).isNotNull(), named(order))).alias("_tail"))
    w_prev = Window.partitionBy("_k").orderBy(so).rowsBetween(Window.unboundedPreceding, -1)
    carry = tail.select("_k", "_s", F.last("_tail", True).over(w_prev).alias("_carry"))
    j = local.join(carry, ["_k", "_s"], "left")
    return j.select(*all_named(df.columns), F.coalesce("_loc", "_carry").alias(out))


def tall_values(df: DataFrame, cols: Sequence[str], group_cols: Sequence[str] = ()) -> DataFrame:
    """``(group..., column, v)`` with ``v`` the double value; NULL/NaN dropped."""
    from loupe.functions.stats import as_double

    items = F.array(*[
        F.struct(F.lit(c).alias("column"), as_double(c).alias("v")) for c in cols
    ])
    t = df.select(*all_named(group_cols), F.explode(items).alias("_it"))
    return t.select(*all_named(group_cols), "_it.column", "_it.v").where(F.col("v").isNotNull())


#: Rank error of the sketches that bracket a quantile is 1/ACCURACY of the rows; up to FEW bracketed rows are finished on the driver.
ACCURACY = 10_000
FEW = 100_000


def exact_quantiles(
    df: DataFrame,
    cols: Sequence[str],
    probs: Sequence[float],
    group_cols: Sequence[str] = (),
    names: Sequence[str] | None = None,
) -> DataFrame:
    """Exact linear-interpolation quantiles (pandas ``quantile`` / SQL ``quantile_cont``).

    Returns one row per ``(group..., column)`` with the non-null count ``n``
    and one column per probability (named ``names`` or ``q<p>``).

    Selection in two steps. One aggregate sketches every column; two values of the sketch, a few rank errors
    apart, bracket each wanted rank. A second aggregate counts the values below each bracket, and only values inside
    one are collapsed to counts and shuffled: a few ten-thousandths of a column (all of a small one), or one row for a value that repeats. The wanted
    ranks are read off those, by a rank pass over slices where they are many. A group whose bracket
    missed its rank would be taken whole; the counts tell.
    """
    names = list(names) if names else [f"q{int(round(p * 100))}" for p in probs]
    cols, probs, group_cols = list(cols), [float(p) for p in probs], list(group_cols)
    keys = [*group_cols, "column"]
    if group_cols:
        stats = materialize(_brackets(df, cols, probs, group_cols))
        near, below = _near_cells(join_small(df.where(_all_present(group_cols)), stats, group_cols), cols, probs, group_cols, None)
        ends = [f"{e}{j}" for j in range(len(probs)) for e in ("lo", "hi")]
        wanted = materialize(_tall(stats, cols, [("n", "n"), *[(e, e) for e in ends]], group_cols).join(
            _tall(below, cols, [(f"below{j}", f"below{j}") for j in range(len(probs))], group_cols), keys).where("n > 0"))
    else:
        one = _brackets(df, cols, probs, []).first().asDict()
        near, below = _near_cells(df, cols, probs, [], one)
        one |= below.first().asDict()
        names_of = ["n", *[f"{e}{j}" for e in ("lo", "hi", "below") for j in range(len(probs))]]
        wanted = df.sparkSession.createDataFrame(
            [(c, *[one[f"{x}_{i}"] for x in names_of]) for i, c in enumerate(cols) if one[f"n_{i}"]],
            ", ".join(["column string", "n bigint", *[f"{x} {'bigint' if x.startswith('below') else 'double'}" for x in names_of[1:]]]))
    found = near.groupBy(*all_named(keys), "v").agg(F.count(F.lit(1)).alias("cnt"))
    if group_cols:
        found = materialize(found)
    else:
        alone = {(c, one[f"lo{j}_{i}"], one[f"at{j}_{i}"]) for i, c in enumerate(cols) for j in range(len(probs)) if one.get(f"at{j}_{i}")}
        if alone:  # a value may lie in a wider bracket of its column too
            alone = df.sparkSession.createDataFrame(sorted(alone), "column string, v double, cnt bigint")
            found = found.unionByName(alone).groupBy("column", "v").agg(F.max("cnt").alias("cnt"))
    rows = found.select(*all_named(keys), "v", "cnt").limit(FEW + 1).collect()
    asked = wanted.limit(FEW + 1).collect() if len(rows) <= FEW else rows
    if len(asked) <= FEW:
        picked = _pick_local(rows, asked, wanted.schema, keys, probs, df.sparkSession)
        missed = picked is None
    else:
        picked = _pick(found if group_cols else materialize(found), wanted, keys, probs)
        missed = not picked.where(" OR ".join(f"a{j} IS NULL OR b{j} IS NULL" for j in range(len(probs)))).limit(1).isEmpty()
    if missed:
        return _ranked_quantiles(df, cols, probs, group_cols, names)
    outs = []
    for j, (p, name) in enumerate(zip(probs, names)):
        pos = (F.col("n") - 1).cast("double") * F.lit(p)
        part, a, b = pos - F.floor(pos), F.col(f"a{j}"), F.col(f"b{j}")
        outs.append(F.when(part == 0, a).otherwise(a + (b - a) * part).alias(name))
    return picked.select(*all_named(keys), "n", *outs)


def _all_present(cols: Sequence[str]):
    ok = F.lit(True)
    for c in cols:
        ok = ok & named(c).isNotNull()
    return ok


def _brackets(df: DataFrame, cols: list[str], probs: list[float], group_cols: list[str]) -> DataFrame:
    """One row per group: ``n<i>`` and for every probability ``lo<j>_<i>``, ``hi<j>_<i>`` around its rank in column i."""
    from loupe.functions.stats import as_double

    wide, aggs = 4.0 / ACCURACY, []
    asked = [min(1.0, max(0.0, p + s * wide)) for p in probs for s in (-1, 1)]
    for i, c in enumerate(cols):
        v = as_double(c)
        aggs += [F.count(v).alias(f"n_{i}"), F.min(v).alias(f"min_{i}"), F.max(v).alias(f"max_{i}"), F.percentile_approx(v, asked, ACCURACY).alias(f"sketch_{i}")]
    got = df.where(_all_present(group_cols)).groupBy(*[named(c) for c in group_cols]).agg(*aggs) if group_cols else df.agg(*aggs)
    out = [named(c) for c in group_cols]
    for i in range(len(cols)):
        small = F.col(f"n_{i}") <= ACCURACY
        out.append(F.col(f"n_{i}"))
        for j, p in enumerate(probs):
            lo, hi = F.get(f"sketch_{i}", F.lit(2 * j)), F.get(f"sketch_{i}", F.lit(2 * j + 1))
            out.append((F.col(f"min_{i}") if p - wide <= 0 else F.when(small, F.col(f"min_{i}")).otherwise(lo)).alias(f"lo{j}_{i}"))
            out.append((F.col(f"max_{i}") if p + wide >= 1 else F.when(small, F.col(f"max_{i}")).otherwise(hi)).alias(f"hi{j}_{i}"))
    return got.select(*out)


def _near_cells(rows: DataFrame, cols: list[str], probs: list[float], group_cols: list[str], one: dict | None) -> tuple[DataFrame, DataFrame]:
    """The cells inside any bracket of their column (group..., column, v), and the counts ``below<j>_<i>`` per group."""
    from loupe.functions.stats import as_double

    def end(name: str):
        return named(name) if one is None else F.lit(one[name]).cast("double")

    items, below, any_near = [], [], F.lit(False)
    for i, c in enumerate(cols):
        v, near = as_double(c), F.lit(False)
        for j in range(len(probs)):
            if one is not None and one[f"lo{j}_{i}"] == one[f"hi{j}_{i}"]:  # one value: counted where it stands
                below.append(F.coalesce(F.sum((v == end(f"lo{j}_{i}")).cast("long")), F.lit(0)).alias(f"at{j}_{i}"))
                below.append(F.coalesce(F.sum((v < end(f"lo{j}_{i}")).cast("long")), F.lit(0)).alias(f"below{j}_{i}"))
                continue
            near = near | ((v >= end(f"lo{j}_{i}")) & (v <= end(f"hi{j}_{i}")))
            below.append(F.coalesce(F.sum((v < end(f"lo{j}_{i}")).cast("long")), F.lit(0)).alias(f"below{j}_{i}"))
        near = F.coalesce(near, F.lit(False))
        any_near = any_near | near
        items.append(F.when(near, F.struct(F.lit(c).alias("column"), v.alias("v"))))
    keys = [named(c) for c in group_cols]
    cells = rows.where(any_near).select(*all_named(keys), F.explode(F.array(*items)).alias("_it")).where("_it IS NOT NULL").select(*all_named(keys), "_it.column", "_it.v")
    return cells, (rows.groupBy(*all_named(keys)).agg(*below) if group_cols else rows.agg(*below))


def _tall(wide: DataFrame, cols: list[str], names: list[tuple[str, str]], group_cols: list[str]) -> DataFrame:
    """One row per group and column from columns ``<name>_<i>``."""
    items = F.array(*[F.struct(F.lit(c).alias("column"), *[F.col(f"{name}_{i}").alias(alias) for name, alias in names]) for i, c in enumerate(cols)])
    return wide.select(*[named(c) for c in group_cols], F.explode(items).alias("_t")).select(*[named(c) for c in group_cols], "_t.*")


def _positions(p: float):
    """Lower and upper rank of a quantile, of the row's ``n``."""
    pos = (F.col("n") - 1).cast("double") * F.lit(p)
    return F.floor(pos), F.ceil(pos)


def _pick(found: DataFrame, wanted: DataFrame, keys: list[str], probs: list[float]) -> DataFrame:
    """``keys, n, a<j>, b<j>``: the values at the wanted ranks, by a rank pass over the slices of the bracketed values."""
    ranked = prefix_counts(found, keys, "v", weight="cnt").drop("total")
    rows = join_small(ranked, wanted, keys)
    aggs = []
    for j, p in enumerate(probs):
        # values of lower brackets lie before this one's: start counting at its own lower end
        own = F.when((F.col("v") >= F.col(f"lo{j}")) & (F.col("v") <= F.col(f"hi{j}")), F.col("before"))
        first = F.min(own).over(Window.partitionBy(*[named(k) for k in keys]))
        rows = rows.withColumn(f"_r{j}", own - first + F.col(f"below{j}"))
        for r, alias in zip(_positions(p), ("a", "b")):
            aggs.append(F.max(F.when((F.col(f"_r{j}") <= r) & (r < F.col(f"_r{j}") + F.col("cnt")), F.col("v"))).alias(f"{alias}{j}"))
    return rows.groupBy(*[named(k) for k in keys]).agg(F.max("n").alias("n"), *aggs)


def _pick_local(found: list, wanted: list, types: T.StructType, keys: list[str], probs: list[float], spark) -> DataFrame | None:
    """:func:`_pick` for at most FEW collected rows; None if a bracket missed its rank."""
    import numpy as np

    values: dict[tuple, list] = {}
    for r in found:
        values.setdefault(tuple(r)[:-2], []).append((r["v"], r["cnt"]))
    rows = []
    for r in wanted:
        key = tuple(r[k] for k in keys)
        v, cnt = (np.array(x) for x in zip(*sorted(values.get(key, [(0.0, 0)]))))
        picks = []
        for j, p in enumerate(probs):
            own = (v >= r[f"lo{j}"]) & (v <= r[f"hi{j}"])
            ends = r[f"below{j}"] + np.cumsum(np.where(own, cnt, 0))
            pos = float(r["n"] - 1) * p
            for rank in (int(np.floor(pos)), int(np.ceil(pos))):
                at = int(np.searchsorted(ends, rank, "right"))
                if at == len(v) or not own[at] or rank < r[f"below{j}"]:
                    return None
                picks.append(float(v[at]))
        rows.append((*key, r["n"], *picks))
    fields = [types[k] for k in keys]
    schema = T.StructType([*fields, T.StructField("n", T.LongType()), *[T.StructField(f"{x}{j}", T.DoubleType()) for j in range(len(probs)) for x in "ab"]])
    return spark.createDataFrame(rows, schema)


def _ranked_quantiles(df: DataFrame, cols: list[str], probs: list[float], group_cols: list[str], names: list[str]) -> DataFrame:
    """The quantiles by ranking all values (:func:`prefix_counts`)."""
    keys = [*group_cols, "column"]
    pc = prefix_counts(tall_values(df, cols, group_cols), keys, "v").withColumnRenamed("total", "n")
    aggs, outs = [], []
    for j, (p, name) in enumerate(zip(probs, names)):
        for r, alias in zip(_positions(p), ("a", "b")):
            aggs.append(F.max(F.when((F.col("before") <= r) & (r < F.col("before") + F.col("cnt")), F.col("v"))).alias(f"{alias}{j}"))
        pos = (F.col("n") - 1).cast("double") * F.lit(p)
        part, a, b = pos - F.floor(pos), F.col(f"a{j}"), F.col(f"b{j}")
        outs.append(F.when(part == 0, a).otherwise(a + (b - a) * part).alias(name))
    return pc.groupBy(*[named(k) for k in keys]).agg(F.max("n").alias("n"), *aggs).select(*all_named(keys), "n", *outs)


def row_ranks(
    df: DataFrame,
    keys: Sequence[str],
    order_cols: Sequence[str],
    partitions: int | None = None,
) -> DataFrame:
    """Every row of ``df`` plus ``_rank`` (0-based position inside its key group
    in ``order_cols`` order) and ``_total`` (rows in the group).

    Same scheme as :func:`prefix_counts` but row-level. Ties in
    ``order_cols`` are broken arbitrarily, so the order should be unique or
    tied rows interchangeable (identical copies). NULL keys form their own
    group.
    """
    keys, order_cols = list(keys), list(order_cols)
    numbered = df.withColumn("_tie", F.monotonically_increasing_id())
    r = sliced(numbered, keys, [*order_cols, "_tie"], partitions)
    w_local = Window.partitionBy("_k", "_s").orderBy(*all_named(order_cols), "_tie")
    local = r.withColumn("_run", F.row_number().over(w_local))
    slices = r.groupBy("_k", "_s").agg(F.count(F.lit(1)).alias("_ptot"))
    w_off = (Window.partitionBy("_k").orderBy("_s")
             .rowsBetween(Window.unboundedPreceding, -1))
    offsets = slices.select(
        "_k", "_s",
        F.coalesce(F.sum("_ptot").over(w_off), F.lit(0)).alias("_off"),
        F.sum("_ptot").over(Window.partitionBy("_k")).alias("_total"))
    out = local.join(offsets, ["_k", "_s"])
    return out.select(*all_named(df.columns), (F.col("_off") + F.col("_run") - 1).alias("_rank"), "_total")
