"""DuckDB twins for the profile (B) and EDA (C) sections."""

from __future__ import annotations

from loupe.plans.oracle import DIRTY, DIRTY_COLS, DIRTY_CAT, pct, r6, sql, tall

LI_NUM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
          "l_extendedprice", "l_discount", "l_tax"]
DIRTY_FEATS = ["o_orderkey", "o_custkey", "price", "tenure", "const_num"]
EV_NUM = ["event_id", "user_id", "value"]
DIRTY_DTYPES = {"o_orderkey": "int64", "o_custkey": "int64", "price": "float64",
                "tenure": "float64", "priority": "object", "city": "object",
                "const_num": "float64", "const_str": "object", "status": "object",
                "target": "int64"}


def union(parts: list[str]) -> str:
    return "\n  UNION ALL ".join(parts)


# ---------------------------------------------------------------- B

sql("q_table_overview", """
SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(11 AS BIGINT) AS n_columns,
       CAST(8 AS BIGINT) AS n_numerical, CAST(2 AS BIGINT) AS n_categorical
FROM lineitem""")

sql("q_preview", """
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice,
       CAST(o_orderdate AS VARCHAR) AS o_orderdate, o_orderpriority
FROM orders ORDER BY o_orderkey LIMIT 10""")

_ct = union([f"SELECT '{c}' AS column_name, '{DIRTY_DTYPES[c]}' AS dtype, "
             f"CAST(count({c}) AS BIGINT) AS non_null_count, "
             f"CAST(count(*) - count({c}) AS BIGINT) AS null_count, "
             f"CAST(count(DISTINCT {c}) AS BIGINT) AS unique_count FROM dirty" for c in DIRTY_COLS])
sql("q_column_types", f"WITH {DIRTY}\n{_ct}")

_desc = union([f"SELECT '{c}' AS column_name, CAST(count({c}) AS BIGINT) AS count, "
               f"{r6(f'avg({c})')} AS mean, {r6(f'stddev_samp({c})')} AS std, "
               f"{r6(f'min({c})')} AS min, {r6(f'quantile_cont({c}, 0.25)')} AS q25, "
               f"{r6(f'quantile_cont({c}, 0.5)')} AS q50, {r6(f'quantile_cont({c}, 0.75)')} AS q75, "
               f"{r6(f'max({c})')} AS max FROM lineitem" for c in LI_NUM])
sql("q_describe", _desc)

_cat_counts = union([f"SELECT '{c}' AS column_name, {c} AS value, count(*) AS cnt FROM dirty "
                     f"WHERE {c} IS NOT NULL GROUP BY {c}" for c in DIRTY_CAT])
sql("q_categorical_summary", f"""
WITH {DIRTY},
vc AS ({_cat_counts}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY cnt DESC, value) AS rn,
                  count(*) OVER (PARTITION BY column_name) AS u FROM vc)
SELECT column_name, CAST(u AS BIGINT) AS unique_count, value AS top, CAST(cnt AS BIGINT) AS freq
FROM ranked WHERE rn = 1""")

sql("q_class_distribution", f"""
SELECT lang AS class_value, CAST(count(*) AS BIGINT) AS class_count,
       {pct('count(*)', '(SELECT count(*) FROM documents)')} AS percentage
FROM documents WHERE lang IS NOT NULL GROUP BY lang""")

# ---------------------------------------------------------------- C

_miss = union([f"SELECT '{c}' AS column_name, count(*) - count({c}) AS k, count(*) AS n FROM dirty"
               for c in DIRTY_COLS])
sql("q_missing_summary", f"""
WITH {DIRTY}, m AS ({_miss})
SELECT column_name, CAST(k AS BIGINT) AS missing_count,
       round(CAST(k AS DOUBLE) * 100.0 / n, 2) AS missing_percentage
FROM m WHERE k > 0""")

sql("q_missing_global", f"""
WITH {DIRTY}, m AS ({_miss})
SELECT CAST(sum(k) AS BIGINT) AS total_missing, CAST(max(n) * {len(DIRTY_COLS)} AS BIGINT) AS total_cells,
       round(CAST(sum(k) AS DOUBLE) * 100.0 / (max(n) * {len(DIRTY_COLS)}), 2)
         AS global_missing_percentage
FROM m""")

_names = ", ".join(f"CASE WHEN {c} IS NULL THEN '{c}' END" for c in DIRTY_COLS)
_k = " + ".join(f"CASE WHEN {c} IS NULL THEN 1 ELSE 0 END" for c in DIRTY_COLS)
sql("q_missing_patterns", f"""
WITH {DIRTY}
SELECT concat_ws(',', {_names}) AS missing_columns, CAST({_k} AS BIGINT) AS n_missing,
       CAST(count(*) AS BIGINT) AS row_count
FROM dirty GROUP BY 1, 2""")


def _iqr_sql(src_cte: str, src: str, cols: list[str]) -> str:
    return f"""
WITH {src_cte}t AS ({tall(src, cols)}),
q AS (SELECT column_name, count(v) AS n, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3
      FROM t WHERE v IS NOT NULL GROUP BY column_name),
f AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM q),
k AS (SELECT t.column_name, sum(CASE WHEN v < lo OR v > hi THEN 1 ELSE 0 END) AS c
      FROM t JOIN f ON t.column_name = f.column_name WHERE v IS NOT NULL GROUP BY t.column_name)
SELECT f.column_name, CAST(n AS BIGINT) AS n, {r6('q1')} AS q1, {r6('q3')} AS q3,
       {r6('lo')} AS lower_bound, {r6('hi')} AS upper_bound, CAST(c AS BIGINT) AS iqr_outliers,
       round(CAST(c AS DOUBLE) * 100.0 / n, 2) AS iqr_percentage
FROM f JOIN k ON f.column_name = k.column_name"""


sql("q_outliers_iqr", _iqr_sql("", "events", EV_NUM))


def _z_part(src: str, cols: list[str], tag: str) -> str:
    return f"""
{tag}_t AS ({tall(src, cols)}),
{tag}_m AS (SELECT column_name, avg(v) AS mu, stddev_pop(v) AS sd FROM {tag}_t
            WHERE v IS NOT NULL GROUP BY column_name),
{tag}_z AS (
  SELECT t.column_name, CAST(count(*) AS BIGINT) AS n,
         CAST(sum(CASE WHEN m.sd > 0 AND abs((t.v - m.mu) / m.sd) > 3 THEN 1 ELSE 0 END) AS BIGINT)
           AS zscore_outliers
  FROM {tag}_t t JOIN {tag}_m m ON t.column_name = m.column_name
  WHERE t.v IS NOT NULL GROUP BY t.column_name)"""


sql("q_outliers_zscore", f"""
WITH {DIRTY},{_z_part('events', EV_NUM, 'ev')},{_z_part('dirty', DIRTY_FEATS, 'dd')},
z AS (SELECT * FROM ev_z UNION ALL SELECT * FROM dd_z)
SELECT column_name, n, zscore_outliers,
       round(CAST(zscore_outliers AS DOUBLE) * 100.0 / n, 2) AS zscore_percentage FROM z""")


def _box_sql(src: str, cols: list[str], group: str | None) -> str:
    g = f"{group}, " if group else ""
    gsel = f"t.{group}, " if group else ""
    gon = f" AND t.{group} = q.{group}" if group else ""
    parts = [f"SELECT {g}'{c}' AS column_name, CAST({c} AS DOUBLE) AS v FROM {src}" for c in cols]
    gnn = f" AND {group} IS NOT NULL" if group else ""
    return f"""
WITH t AS ({union(parts)}),
q AS (SELECT {g}column_name, count(v) AS n, quantile_cont(v, 0.25) AS q1,
             quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.75) AS q3
      FROM t WHERE v IS NOT NULL{gnn} GROUP BY {g}column_name),
f AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM q)
SELECT {gsel.replace('t.', 'q.')}q.column_name, CAST(q.n AS BIGINT) AS n, {r6('min(t.v)')} AS min,
       {r6('q.q1')} AS q1, {r6('q.median')} AS median, {r6('q.q3')} AS q3, {r6('max(t.v)')} AS max,
       {r6('min(CASE WHEN t.v >= q.lo AND t.v <= q.hi THEN t.v END)')} AS lower_whisker,
       {r6('max(CASE WHEN t.v >= q.lo AND t.v <= q.hi THEN t.v END)')} AS upper_whisker,
       CAST(sum(CASE WHEN t.v < q.lo OR t.v > q.hi THEN 1 ELSE 0 END) AS BIGINT) AS n_outliers
FROM f q JOIN t ON t.column_name = q.column_name{gon}
WHERE t.v IS NOT NULL
GROUP BY {gsel.replace('t.', 'q.')}q.column_name, q.n, q.q1, q.median, q.q3"""


sql("q_boxplot", _box_sql("events", ["value", "user_id"], None))
sql("q_boxplot_by_class", _box_sql("documents", ["n_chars"], "lang"))

sql("q_histogram", f"""
WITH t AS ({tall('events', ['value', 'user_id'])}),
m AS (SELECT column_name, min(v) AS lo, max(v) AS hi FROM t GROUP BY column_name),
b AS (SELECT t.column_name, m.lo, m.hi,
             CAST(least(CASE WHEN m.hi > m.lo THEN floor((t.v - m.lo) / (m.hi - m.lo) * 30) ELSE 0 END,
                        29) AS BIGINT) AS bin
      FROM t JOIN m ON t.column_name = m.column_name WHERE t.v IS NOT NULL)
SELECT column_name, bin, {r6('lo + CAST(bin AS DOUBLE) * ((hi - lo) / 30)')} AS bin_start,
       {r6('lo + CAST(bin + 1 AS DOUBLE) * ((hi - lo) / 30)')} AS bin_end,
       CAST(count(*) AS BIGINT) AS count
FROM b GROUP BY column_name, bin, lo, hi""")


def _corr(a: str, b: str) -> str:
    return f"CASE WHEN isnan(corr({a}, {b})) THEN NULL ELSE corr({a}, {b}) END"


def _clamp(r: str) -> str:
    return f"CASE WHEN ({r}) IS NULL THEN NULL ELSE greatest(-1.0, least(1.0, {r})) END"


_CORR_COLS = [*DIRTY_FEATS, "target"]
_pairs = []
for i, a in enumerate(_CORR_COLS):
    for b in _CORR_COLS:
        if a == b:
            expr = f"CASE WHEN {_corr(a, a)} IS NULL THEN NULL ELSE 1.0 END"
        else:
            expr = _clamp(_corr(a, b))
        _pairs.append(f"SELECT '{a}' AS col_a, '{b}' AS col_b, {r6(expr)} AS correlation FROM dirty")
sql("q_correlation_matrix", f"WITH {DIRTY}\n{union(_pairs)}")

sql("q_target_correlation", f"WITH {DIRTY}\n" + union([
    f"SELECT '{a}' AS feature, round({_clamp(_corr(a, 'target'))}, 3) AS correlation "
    f"FROM dirty" for a in DIRTY_FEATS]))

_hp = []
for i, a in enumerate(LI_NUM):
    for b in LI_NUM[i + 1:]:
        _hp.append(f"SELECT '{a}' AS feature_1, '{b}' AS feature_2, "
                   f"{_clamp(_corr(a, b))} AS r FROM lineitem")
_DERIVED = {**{c: c for c in LI_NUM}, "gross": "l_extendedprice * (1 + l_tax)", "returned": "-l_quantity"}
_hd = [f"SELECT '{a}' AS feature_1, '{b}' AS feature_2, {_clamp(_corr(f'({_DERIVED[a]})', f'({_DERIVED[b]})'))} AS r FROM lineitem"
       for i, a in enumerate(_DERIVED) for b in list(_DERIVED)[i + 1:]]
sql("q_high_corr_derived", f"""
WITH p AS ({union(_hd)})
SELECT feature_1, feature_2, round(r, 3) AS correlation FROM p WHERE abs(r) > 0.8""")
sql("q_high_corr_pairs", f"""
WITH p AS ({union(_hp)})
SELECT feature_1, feature_2, round(r, 3) AS correlation FROM p WHERE abs(r) > 0.8""")

_mom = union([
    f"SELECT '{c}' AS column_name, {r6(f'avg({c})')} AS mean, {r6(f'quantile_cont({c}, 0.5)')} AS median, "
    f"{r6(f'stddev_samp({c})')} AS std, {r6(f'var_samp({c})')} AS var, "
    f"{r6(f'CASE WHEN count({c}) < 3 THEN NULL WHEN stddev_pop({c}) = 0 THEN 0.0 ELSE skewness({c}) END')}"
    f" AS skewness, "
    f"{r6(f'CASE WHEN count({c}) < 4 THEN NULL WHEN stddev_pop({c}) = 0 THEN 0.0 ELSE kurtosis({c}) END')}"
    f" AS kurtosis FROM dirty" for c in DIRTY_FEATS])
sql("q_moments", f"WITH {DIRTY}\n{_mom}")

sql("q_sample_cap", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM lineitem
ORDER BY md5(concat(concat_ws('-', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR),
                              CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR)), ':42')),
         l_orderkey, l_linenumber, l_partkey, l_suppkey
LIMIT 100000""")

sql("q_value_counts", f"""
WITH {DIRTY}
SELECT priority AS category, CAST(count(*) AS BIGINT) AS count,
       round(CAST(count(*) AS DOUBLE) * 100.0 / (SELECT count(*) FROM dirty), 2) AS percentage
FROM dirty WHERE priority IS NOT NULL GROUP BY priority""")

sql("q_crosstab_pct", f"""
WITH {DIRTY},
d AS (SELECT priority AS category, CAST(target AS VARCHAR) AS class_value FROM dirty
      WHERE priority IS NOT NULL AND target IS NOT NULL),
c AS (SELECT category, class_value, count(*) AS k FROM d GROUP BY 1, 2),
g AS (SELECT a.category, b.class_value FROM (SELECT DISTINCT category FROM c) a
      JOIN (SELECT DISTINCT class_value FROM c) b ON TRUE),
f AS (SELECT g.category, g.class_value, coalesce(c.k, 0) AS k FROM g LEFT JOIN c
      ON g.category = c.category AND g.class_value = c.class_value)
SELECT category, class_value, CAST(k AS BIGINT) AS count,
       round(CAST(k AS DOUBLE) * 100.0 / sum(k) OVER (PARTITION BY category), 2) AS percentage
FROM f""")

sql("q_split_sizes", """
SELECT CAST(t AS BIGINT) AS test_percentage, CAST(n AS BIGINT) AS n_total,
       CAST(floor(n * (100 - t) / 100) AS BIGINT) AS n_train,
       CAST(n - CAST(floor(n * (100 - t) / 100) AS BIGINT) AS BIGINT) AS n_test
FROM (SELECT count(*) AS n FROM lineitem) c
JOIN (VALUES (10), (15), (20), (25), (30), (35), (40)) v(t) ON TRUE""")


def _horner_sql(coefs: list[float], x: str) -> str:
    acc = repr(coefs[0])
    for c in coefs[1:]:
        acc = f"({acc} * {x} + {c!r})"
    return acc


def _ppf_sql(p: str) -> str:
    from loupe.functions.stats import _A, _B, _C, _D, _P_LOW
    q, r = f"({p} - 0.5)", f"(({p} - 0.5) * ({p} - 0.5))"
    central = f"({_horner_sql(_A, r)} * {q} / ({_horner_sql(_B, r)} * {r} + 1.0))"
    ql = f"sqrt(-2.0 * ln({p}))"
    lower = f"({_horner_sql(_C, ql)} / ({_horner_sql(_D, ql)} * {ql} + 1.0))"
    qu = f"sqrt(-2.0 * ln(1.0 - {p}))"
    upper = f"(-{_horner_sql(_C, qu)} / ({_horner_sql(_D, qu)} * {qu} + 1.0))"
    return (f"CASE WHEN {p} < {_P_LOW!r} THEN {lower} WHEN {p} > {1.0 - _P_LOW!r} THEN {upper} "
            f"ELSE {central} END")


sql("q_qq_fit", f"""
WITH t AS ({tall('events', ['value', 'user_id'])}),
r AS (SELECT column_name, v,
             row_number() OVER (PARTITION BY column_name ORDER BY v) AS i,
             count(*) OVER (PARTITION BY column_name) AS n
      FROM t WHERE v IS NOT NULL),
m AS (SELECT *, CASE WHEN i = n THEN pow(0.5, 1.0 / n)
                     WHEN i = 1 THEN 1.0 - pow(0.5, 1.0 / n)
                     ELSE (i - 0.3175) / (n + 0.365) END AS p FROM r),
q AS (SELECT column_name, v, {_ppf_sql('p')} AS theoretical FROM m)
SELECT column_name, CAST(count(*) AS BIGINT) AS n, {r6('regr_slope(v, theoretical)')} AS slope,
       {r6('regr_intercept(v, theoretical)')} AS intercept,
       {r6('CASE WHEN isnan(corr(v, theoretical)) THEN NULL ELSE greatest(-1.0, least(1.0, corr(v, theoretical))) END')} AS r
FROM q GROUP BY column_name""")
