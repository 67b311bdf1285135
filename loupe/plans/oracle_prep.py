"""DuckDB twins for the preprocessing section (E)."""

from __future__ import annotations

from loupe.plans.oracle import DIRTY, r6, sql

FEATS = ["o_orderkey", "o_custkey", "price", "tenure", "const_num"]
CATS = ["priority", "city", "const_str", "status"]
PLANTED = ["l_quantity", "l_discount", "l_tax", "l_extendedprice"]

PLANTED_CTE = """
planted AS (
  SELECT concat_ws('-', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR),
                   CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR)) AS row_key,
         l_quantity, l_discount, l_tax, l_extendedprice,
         CAST(CASE WHEN l_quantity > 25 AND l_discount > 0.04 THEN 1 ELSE 0 END AS INTEGER) AS label,
         CASE WHEN l_orderkey % 5 = 0 THEN 'test' ELSE 'train' END AS split
  FROM lineitem)"""

# all numeric features of dirty_orders, fences of those with outliers (unrounded)
FENCES = """
num_tall AS (
  SELECT 'o_orderkey' AS column_name, CAST(o_orderkey AS DOUBLE) AS v FROM dirty
  UNION ALL SELECT 'o_custkey', CAST(o_custkey AS DOUBLE) FROM dirty
  UNION ALL SELECT 'price', price FROM dirty
  UNION ALL SELECT 'tenure', tenure FROM dirty
  UNION ALL SELECT 'const_num', const_num FROM dirty),
fq AS (SELECT column_name, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3
       FROM num_tall WHERE v IS NOT NULL GROUP BY column_name),
fb AS (SELECT column_name, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM fq),
flagged AS (
  SELECT fb.* FROM fb JOIN num_tall t ON t.column_name = fb.column_name
  WHERE t.v < fb.lo OR t.v > fb.hi GROUP BY ALL)"""


def _b(col: str, side: str) -> str:
    return f"(SELECT {side} FROM flagged WHERE column_name = '{col}')"


sql("q_dedupe", f"""
WITH {DIRTY}
SELECT o_orderkey, o_custkey, {r6('price')} AS price, {r6('tenure')} AS tenure, priority, city,
       {r6('const_num')} AS const_num, const_str, status, target
FROM (SELECT DISTINCT * FROM dirty)""")

sql("q_drop_constant", f"""
WITH {DIRTY}
SELECT o_orderkey, o_custkey, {r6('price')} AS price, const_str, target FROM dirty""")


def _imp(fill: str) -> str:
    cols = ", ".join(f"{r6(f'coalesce(CAST({c} AS DOUBLE), {fill.format(c=c)})')} AS {c}"
                     for c in FEATS)
    return f"WITH {DIRTY}\nSELECT {cols} FROM dirty"


sql("q_impute_numeric_mean", _imp("(SELECT avg({c}) FROM dirty)"))
sql("q_impute_numeric_median", _imp("(SELECT quantile_cont({c}, 0.5) FROM dirty)"))
sql("q_impute_numeric_mode", _imp(
    "(SELECT CAST({c} AS DOUBLE) FROM dirty WHERE {c} IS NOT NULL GROUP BY {c} "
    "ORDER BY count(*) DESC, {c} LIMIT 1)"))

_modes = ", ".join(
    f"coalesce({c}, (SELECT {c} FROM dirty WHERE {c} IS NOT NULL GROUP BY {c} "
    f"ORDER BY count(*) DESC, {c} LIMIT 1)) AS {c}" for c in CATS)
sql("q_impute_categorical", f"WITH {DIRTY}\nSELECT o_orderkey, {_modes} FROM dirty")
sql("q_impute_categorical_constant", f"WITH {DIRTY}\nSELECT o_orderkey, " +
    ", ".join(f"coalesce({c}, 'Unknown') AS {c}" for c in CATS) + " FROM dirty")


def _cap(c: str) -> str:
    lo, hi = _b(c, "lo"), _b(c, "hi")
    return (f"{r6(f'CASE WHEN {c} < {lo} THEN {lo} WHEN {c} > {hi} THEN {hi} '
                  f'ELSE CAST({c} AS DOUBLE) END')} AS {c}")


sql("q_cap_outliers", f"""
WITH {DIRTY}, {FENCES}
SELECT o_orderkey, {_cap('price')}, {_cap('tenure')} FROM dirty""")


def _inside(c: str) -> str:
    lo, hi = _b(c, "lo"), _b(c, "hi")
    return (f"((SELECT count(*) FROM flagged WHERE column_name = '{c}') = 0 "
            f"OR coalesce({c} >= {lo} AND {c} <= {hi}, false))")


sql("q_remove_outliers", f"""
WITH {DIRTY}, {FENCES}
SELECT o_orderkey, {r6('price')} AS price, {r6('tenure')} AS tenure, target FROM dirty
WHERE {_inside('price')} AND {_inside('tenure')}""")

sql("q_group_rare", """
WITH s AS (SELECT role, count(*) * 1.0 / sum(count(*)) OVER () AS share FROM conversations
           WHERE role IS NOT NULL GROUP BY role)
SELECT conv_id, turn,
       CASE WHEN role IS NULL OR role IN (SELECT role FROM s WHERE share >= 0.05) THEN role
            ELSE 'Other' END AS role
FROM conversations""")

_num_with_nulls = ["price", "tenure"]
_cat_with_nulls = ["priority"]
sql("q_auto_impute", f"""
WITH {DIRTY}
SELECT o_orderkey, o_custkey,
  {r6("coalesce(price, (SELECT quantile_cont(price, 0.5) FROM dirty))")} AS price,
  {r6("coalesce(tenure, (SELECT quantile_cont(tenure, 0.5) FROM dirty))")} AS tenure,
  coalesce(priority, (SELECT priority FROM dirty WHERE priority IS NOT NULL GROUP BY priority
                      ORDER BY count(*) DESC, priority LIMIT 1)) AS priority,
  city, {r6('const_num')} AS const_num, const_str, status, target
FROM dirty""")

_pri = ["2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
sql("q_one_hot", f"WITH {DIRTY}\nSELECT o_orderkey, " + ", ".join(
    [f"CAST(CASE WHEN priority = '{v}' THEN 1 ELSE 0 END AS INTEGER) AS \"priority_{v}\""
     for v in _pri]
    + ["CAST(CASE WHEN status = 'Inactive' THEN 1 ELSE 0 END AS INTEGER) AS \"status_Inactive\""])
    + " FROM dirty")

sql("q_one_hot_sparse", f"""
WITH {DIRTY},
d AS (SELECT o_orderkey, concat('k', CAST(o_orderkey AS VARCHAR)) AS key, city, priority FROM dirty),
n AS (SELECT count(DISTINCT key) - 1 AS k, count(DISTINCT city) - 1 AS c FROM d),
codes AS (SELECT o_orderkey, dense_rank() OVER (ORDER BY key) - 2 AS a, dense_rank() OVER (ORDER BY city) - 2 AS b,
  CASE WHEN priority IS NOT NULL THEN dense_rank() OVER (ORDER BY priority NULLS LAST) - 2 END AS p FROM d)
SELECT o_orderkey, CAST(a AS INTEGER) AS place FROM codes WHERE a >= 0
UNION ALL SELECT o_orderkey, CAST(k + b AS INTEGER) FROM codes, n WHERE b >= 0
UNION ALL SELECT o_orderkey, CAST(k + c + p AS INTEGER) FROM codes, n WHERE p >= 0""")

sql("q_label_encode", f"""
WITH {DIRTY}
SELECT o_orderkey,
  CAST(dense_rank() OVER (ORDER BY coalesce(city, 'nan')) - 1 AS BIGINT) AS city,
  CAST(dense_rank() OVER (ORDER BY coalesce(priority, 'nan')) - 1 AS BIGINT) AS priority
FROM dirty""")

sql("q_target_encode_labels", """
SELECT doc_id, lang, CAST(dense_rank() OVER (ORDER BY coalesce(lang, 'nan')) - 1 AS BIGINT) AS label
FROM documents""")

QUOTAS = """
qc AS (SELECT target, count(*) AS n_class FROM dirty GROUP BY target),
qt AS (SELECT *, sum(n_class) OVER () AS n FROM qc),
qt2 AS (SELECT *, n - CAST(ceil(CAST(0.2 AS DOUBLE) * n) AS BIGINT) AS ntrain FROM qt),
qt3 AS (SELECT *, floor(CAST(ntrain * n_class AS DOUBLE) / n) AS fl,
               CAST(ntrain * n_class AS DOUBLE) / n - floor(CAST(ntrain * n_class AS DOUBLE) / n) AS rem
        FROM qt2),
qt4 AS (SELECT *, ntrain - sum(fl) OVER () AS lft,
               row_number() OVER (ORDER BY rem DESC, target) AS ro FROM qt3),
quota AS (SELECT target, n_class,
                 n_class - (fl + CASE WHEN ro <= lft THEN 1 ELSE 0 END) AS n_test FROM qt4),
ranked AS (
  SELECT o_orderkey, target,
         row_number() OVER (PARTITION BY target
                            ORDER BY md5(concat(CAST(o_orderkey AS VARCHAR), ':42')), o_orderkey) - 1
           AS rk
  FROM dirty),
strat AS (
  SELECT r.o_orderkey, r.target, CASE WHEN r.rk < q.n_test THEN 'test' ELSE 'train' END AS split
  FROM ranked r JOIN quota q ON r.target = q.target)"""

sql("q_stratified_split", f"WITH {DIRTY}, {QUOTAS}\nSELECT * FROM strat")

sql("q_random_split", f"""
WITH {DIRTY},
r AS (SELECT o_orderkey, target,
             row_number() OVER (ORDER BY md5(concat(CAST(o_orderkey AS VARCHAR), ':42')), o_orderkey) - 1
               AS rk,
             count(*) OVER () AS n
      FROM dirty)
SELECT o_orderkey, target,
       CASE WHEN rk < ceil(CAST(0.2 AS DOUBLE) * n) THEN 'test' ELSE 'train' END AS split
FROM r""")

sql("q_undersample", f"""
WITH {DIRTY}, {QUOTAS}
SELECT o_orderkey, target FROM ranked
WHERE rk < (SELECT min(n_class) FROM qc)""")

sql("q_class_weights", f"""
WITH {DIRTY},
c AS (SELECT target, count(*) AS k FROM dirty GROUP BY target)
SELECT CAST(target AS VARCHAR) AS class_value, CAST(k AS BIGINT) AS class_count,
       {r6('CAST(sum(k) OVER () AS DOUBLE) / (count(*) OVER () * k)')} AS weight
FROM c""")

_std = ", ".join(
    f"{r6(f'(CAST({c} AS DOUBLE) - (SELECT avg({c}) FROM planted WHERE split = {chr(39)}train{chr(39)})) / '
          f'(SELECT CASE WHEN coalesce(stddev_pop({c}), 0) = 0 THEN 1.0 ELSE stddev_pop({c}) END '
          f'FROM planted WHERE split = {chr(39)}train{chr(39)})')} AS {c}" for c in PLANTED)
sql("q_standard_scale", f"WITH {PLANTED_CTE}\nSELECT row_key, split, {_std} FROM planted")

_mm = ", ".join(
    f"{r6(f'(CAST({c} AS DOUBLE) - (SELECT min({c}) FROM planted WHERE split = {chr(39)}train{chr(39)})) / '
          f'(SELECT CASE WHEN max({c}) - min({c}) = 0 THEN 1.0 ELSE max({c}) - min({c}) END '
          f'FROM planted WHERE split = {chr(39)}train{chr(39)})')} AS {c}" for c in PLANTED)
sql("q_minmax_scale", f"WITH {PLANTED_CTE}\nSELECT row_key, split, {_mm} FROM planted")

sql("q_train_class_distribution", f"""
WITH {DIRTY}, {QUOTAS},
tr AS (SELECT target, count(*) AS k FROM strat WHERE split = 'train' GROUP BY target)
SELECT CAST(target AS VARCHAR) AS class_value, CAST(k AS BIGINT) AS count,
       round(CAST(k AS DOUBLE) * 100.0 / sum(k) OVER (), 2) AS percentage
FROM tr""")


# ---------------------------------------------------------------- F: models (SQL-expressible ones)

sql("q_model_majority", f"""
WITH {PLANTED_CTE},
m AS (SELECT label AS mode FROM planted WHERE split = 'train' GROUP BY label
      ORDER BY count(*) DESC, label LIMIT 1)
SELECT row_key, label, CAST(m.mode AS INTEGER) AS prediction,
       CASE WHEN m.mode = 0 THEN 0.8 ELSE 0.2 END AS p0,
       CASE WHEN m.mode = 1 THEN 0.8 ELSE 0.2 END AS p1,
       CASE WHEN m.mode = 1 THEN 0.8 ELSE 0.2 END AS score
FROM planted JOIN m ON TRUE WHERE split = 'test'""")

_F = PLANTED
_var_max = "greatest(" + ", ".join(f"var_pop({f})" for f in _F) + ")"
_cs = ", ".join(f"avg({f}) AS m_{f}, var_pop({f}) AS v_{f}" for f in _F)
_cs2 = ", ".join(f"m_{f}, v_{f} + e AS v_{f}" for f in _F)
_norm = " + ".join(f"ln(2 * pi() * v_{f})" for f in _F)
_quad = " - ".join(f"pow(te.{f} - m_{f}, 2) / (2 * v_{f})" for f in _F)
sql("q_model_gnb", f"""
WITH {PLANTED_CTE},
tr AS (SELECT * FROM planted WHERE split = 'train'),
te AS (SELECT * FROM planted WHERE split = 'test'),
eps AS (SELECT 1e-9 * {_var_max} AS e FROM tr),
cs AS (SELECT label AS cls, count(*) AS n, {_cs} FROM tr GROUP BY label),
cs2 AS (SELECT cls, ln(CAST(n AS DOUBLE) / (SELECT count(*) FROM tr)) AS lp, {_cs2}
        FROM cs JOIN eps ON TRUE),
jl AS (SELECT te.row_key, te.label, cs2.cls,
              lp - 0.5 * ({_norm}) - {_quad} AS jll
       FROM te JOIN cs2 ON TRUE),
b AS (SELECT *, row_number() OVER (PARTITION BY row_key ORDER BY jll DESC, cls) AS rn FROM jl)
SELECT row_key, label, cls AS prediction FROM b WHERE rn = 1""")

sql("q_model_knn", """
WITH e AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS vec, CAST(label AS BIGINT) AS label
           FROM embeddings),
tr AS (SELECT * FROM e WHERE id % 5 <> 0),
te AS (SELECT * FROM e WHERE id % 5 = 0),
d AS (SELECT te.id AS row_id, te.label, tr.id AS train_id, tr.label AS nb_label,
             list_distance(te.vec, tr.vec) AS dist
      FROM te JOIN tr ON TRUE),
nn AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY dist, train_id) AS r FROM d),
v AS (SELECT row_id, label, nb_label, count(*) AS votes FROM nn WHERE r <= 5 GROUP BY ALL),
b AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY votes DESC, nb_label) AS rr FROM v)
SELECT row_id, label, nb_label AS prediction FROM b WHERE rr = 1""")

sql("q_cv_folds", f"""
WITH {DIRTY},
m AS (SELECT min(k) AS min_class_count FROM (SELECT target, count(*) AS k FROM dirty GROUP BY target))
SELECT CAST(min_class_count AS BIGINT) AS min_class_count,
       CAST(least(10, min_class_count) AS BIGINT) AS max_folds,
       CAST(CASE WHEN least(10, min_class_count) < 2 THEN 2 ELSE least(5, least(10, min_class_count)) END
            AS BIGINT) AS folds,
       least(10, min_class_count) >= 2 AS search_enabled
FROM m""")

sql("q_cv_fold_assignment", f"""
WITH {DIRTY}
SELECT o_orderkey, target,
       CAST((row_number() OVER (PARTITION BY target
             ORDER BY md5(concat(CAST(o_orderkey AS VARCHAR), ':42')), o_orderkey) - 1) % 5 AS INTEGER)
         AS fold
FROM dirty""")


NAN_CTE = DIRTY + """,
nans AS (SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN 'NaN'::DOUBLE ELSE price END AS price, tenure FROM dirty),
held AS (SELECT o_orderkey, CASE WHEN isnan(price) THEN NULL ELSE price END AS price, tenure FROM nans)"""

sql("q_impute_nan", f"""
WITH {NAN_CTE}
SELECT o_orderkey, {r6('coalesce(price, (SELECT quantile_cont(price, 0.5) FROM held))')} AS price,
       {r6('coalesce(tenure, (SELECT quantile_cont(tenure, 0.5) FROM held))')} AS tenure FROM held""")


def _capped(c: str) -> str:
    lo = f"(SELECT quantile_cont({c}, 0.25) - 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) FROM held)"
    hi = f"(SELECT quantile_cont({c}, 0.75) + 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) FROM held)"
    return r6(f"CASE WHEN {c} < {lo} THEN {lo} WHEN {c} > {hi} THEN {hi} ELSE {c} END")


sql("q_cap_nan", f"""
WITH {NAN_CTE}
SELECT o_orderkey, {_capped('price')} AS price, {_capped('tenure')} AS tenure FROM held""")

sql("q_missing_summary_nan", f"""
WITH {NAN_CTE}, n AS (SELECT count(*) AS n FROM held),
m AS (SELECT 'price' AS column_name, count(*) - count(price) AS c FROM held
      UNION ALL SELECT 'tenure', count(*) - count(tenure) FROM held
      UNION ALL SELECT 'o_orderkey', count(*) - count(o_orderkey) FROM held)
SELECT column_name, CAST(c AS BIGINT) AS missing_count, round(c * 100.0::DOUBLE / n, 2) AS missing_percentage FROM m, n WHERE c > 0""")

sql("q_sample_cap_small", """
SELECT o_orderkey, o_totalprice FROM orders ORDER BY md5(concat(CAST(o_orderkey AS VARCHAR), ':42')), o_orderkey LIMIT 500""")

sql("q_smote", f"""
WITH {PLANTED_CTE},
c AS (SELECT label, count(*) AS n FROM planted WHERE split = 'train' GROUP BY label)
SELECT CAST(label AS INTEGER) AS label, false AS synthetic, CAST(n AS BIGINT) AS rows FROM c
UNION ALL SELECT CAST(label AS INTEGER), true, CAST((SELECT max(n) FROM c) - n AS BIGINT) FROM c WHERE n < (SELECT max(n) FROM c)""")

_three = "CASE WHEN label = 1 THEN 2 WHEN l_discount > 0.04 THEN 1 ELSE 0 END"
for _query, _models in (("q_train_status", ["logistic_regression", "decision_tree", "naive_bayes", "rule_based"]), ("q_train_status_more", ["knn", "random_forest", "svm", "rule_based"])):
    sql(_query, f"""
WITH {PLANTED_CTE},
m AS (SELECT unnest({_models}) AS model)
SELECT model, 'ok' AS status, (SELECT CAST(count(DISTINCT {_three}) AS INTEGER) FROM planted WHERE split = 'train') AS n_classes,
       (SELECT CAST(count(*) AS BIGINT) FROM planted WHERE split = 'test') AS n_rows, model <> 'rule_based' AS beats_majority FROM m""")

# five of the columns are (near-)constant, so two numbers and one string remain as features
sql("q_prep_summary", f"""
WITH {DIRTY}, {FENCES},
u AS (SELECT DISTINCT * FROM dirty),
c AS (SELECT (SELECT count(*) FROM dirty) AS n, (SELECT count(*) FROM u) AS d,
             (SELECT count(*) FROM u WHERE price < {_b('price', 'lo')} OR price > {_b('price', 'hi')}) AS o),
s AS (SELECT *, CAST(ceil(CAST(0.2 AS DOUBLE) * (d - o)) AS BIGINT) AS t FROM c)
SELECT 'input' AS step, 'rows' AS metric, CAST(n AS DOUBLE) AS value FROM s
UNION ALL SELECT 'remove_duplicates', 'rows_removed', CAST(n - d AS DOUBLE) FROM s
UNION ALL SELECT 'remove_constant_features', 'columns_removed', 5.0::DOUBLE
UNION ALL SELECT 'impute', 'columns', 3.0::DOUBLE
UNION ALL SELECT 'remove_outliers', 'rows_removed', CAST(o AS DOUBLE) FROM s
UNION ALL SELECT 'encode', 'columns', 1.0::DOUBLE
UNION ALL SELECT 'split', 'train_rows', CAST(d - o - t AS DOUBLE) FROM s
UNION ALL SELECT 'split', 'test_rows', CAST(t AS DOUBLE) FROM s
UNION ALL SELECT 'scale_standard', 'columns', 2.0::DOUBLE""")


# ---------------------------------------------------------------- F8: searches whose fits SQL can express

#: Mean over folds of the weighted F1, from the CTE conf (setting, fold, label, prediction, n).
_MEAN_F1 = """
sup AS (SELECT setting, fold, label, sum(n) AS s, sum(CASE WHEN label = prediction THEN n ELSE 0 END) AS tp FROM conf GROUP BY ALL),
prd AS (SELECT setting, fold, prediction AS label, sum(n) AS p FROM conf GROUP BY ALL),
f1 AS (SELECT setting, fold, sum(s * 2.0 * tp / (s + coalesce(p, 0))) / sum(s) AS f1 FROM sup LEFT JOIN prd USING (setting, fold, label) GROUP BY setting, fold),
mean AS (SELECT setting, round(avg(f1), 9) AS mean_f1 FROM f1 GROUP BY setting)
SELECT setting, mean_f1, CAST(row_number() OVER (ORDER BY mean_f1 DESC, setting) AS INTEGER) AS rank FROM mean"""

_gm = ", ".join(f"avg({f}) AS m_{f}, var_pop({f}) AS v_{f}" for f in _F)
_gj = " - ".join(f"pow(d.{f} - m_{f}, 2) / (2 * (v_{f} + e))" for f in _F)
_gn = " + ".join(f"ln(2 * pi() * (v_{f} + e))" for f in _F)
sql("q_gnb_search", f"""
WITH {PLANTED_CTE},
d AS (SELECT *, (row_number() OVER (PARTITION BY label ORDER BY md5(concat(row_key, ':42')), row_key) - 1) % 5 AS fold FROM planted WHERE split = 'train'),
fo AS (SELECT unnest(range(5)) AS held),
gs AS (SELECT held, label AS cls, count(*) AS n, {_gm} FROM d JOIN fo ON fold <> held GROUP BY ALL),
ga AS (SELECT held, count(*) AS total, {_var_max} AS spread FROM d JOIN fo ON fold <> held GROUP BY held),
st AS (SELECT unnest(['1e-09', '1e-08', '1e-07', '1e-06']) AS txt),
par AS (SELECT gs.*, concat('var_smoothing=', txt) AS setting, CAST(txt AS DOUBLE) * spread AS e, ln(CAST(n AS DOUBLE) / total) AS lp FROM gs JOIN ga USING (held) JOIN st ON TRUE),
jl AS (SELECT setting, fold, row_key, label, cls, lp - 0.5 * ({_gn}) - {_gj} AS jll FROM d JOIN par ON par.held = d.fold),
best AS (SELECT setting, fold, row_key, label, max_by(cls, (jll, -cls)) AS prediction FROM jl GROUP BY ALL),
conf AS (SELECT setting, fold, label, prediction, count(*) AS n FROM best GROUP BY ALL),{_MEAN_F1}""")

sql("q_knn_search", f"""
WITH d AS (SELECT *, (row_number() OVER (PARTITION BY label ORDER BY md5(concat(CAST(id AS VARCHAR), ':42')), id) - 1) % 5 AS fold
  FROM (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS vec, CAST(label AS BIGINT) AS label FROM embeddings WHERE vec_id % 5 <> 0)),
pairs AS (SELECT a.fold, a.id, a.label, b.id AS near, b.label AS nb, list_distance(a.vec, b.vec) AS euclidean,
  list_sum(list_transform(list_zip(a.vec, b.vec), lambda z: abs(z[1] - z[2]))) AS manhattan FROM d a JOIN d b ON a.fold <> b.fold),
tall AS (SELECT fold, id, label, near, nb, 'euclidean' AS metric, euclidean AS dist FROM pairs UNION ALL SELECT fold, id, label, near, nb, 'manhattan', manhattan FROM pairs),
rk AS (SELECT *, row_number() OVER (PARTITION BY metric, id ORDER BY dist, near) AS r FROM tall),
st AS (SELECT * FROM (SELECT unnest([3, 5, 7, 9]) AS k) JOIN (SELECT unnest(['uniform', 'distance']) AS w) ON TRUE),
v AS (SELECT concat('n_neighbors=', CAST(k AS VARCHAR), ',weights=', w, ',metric=', metric) AS setting, fold, id, label, nb,
  sum(CASE WHEN w = 'uniform' THEN 1.0::DOUBLE ELSE 1.0::DOUBLE / dist END) AS v FROM rk JOIN st ON r <= k GROUP BY ALL),
best AS (SELECT setting, fold, id, label, max_by(nb, (v, -nb)) AS prediction FROM v GROUP BY ALL),
conf AS (SELECT setting, fold, label, prediction, count(*) AS n FROM best GROUP BY ALL),{_MEAN_F1}""")


# ---------------------------------------------------------------- F1, F3, F6: certificates of the fits

_terms = "SELECT unnest(" + str([*PLANTED, "intercept"]) + ") AS term, true AS at_optimum"
sql("q_logreg_certificate", _terms)
sql("q_svm_certificate", _terms)

_values = " UNION ALL ".join(f"SELECT '{f}' AS feature, CAST({f} AS DOUBLE) AS v, label FROM planted WHERE split = 'train'" for f in PLANTED)
sql("q_tree_root", f"""
WITH {PLANTED_CTE},
tall AS ({_values}),
g AS (SELECT feature, v, count(*) AS n, sum(label) AS p FROM tall GROUP BY ALL),
c AS (SELECT feature, v, lead(v) OVER w AS after, sum(n) OVER w AS n, sum(p) OVER w AS p, sum(n) OVER (PARTITION BY feature) AS nt, sum(p) OVER (PARTITION BY feature) AS pt
      FROM g WINDOW w AS (PARTITION BY feature ORDER BY v)),
s AS (SELECT feature, (v + after) / 2 AS threshold, CAST(n AS DOUBLE) AS n, CAST(p AS DOUBLE) AS p, CAST(nt - n AS DOUBLE) AS m, CAST(pt - p AS DOUBLE) AS q FROM c WHERE after IS NOT NULL)
SELECT feature, round(threshold, 6) AS threshold FROM s ORDER BY p * (n - p) / n + q * (m - q) / m, feature LIMIT 1""")
