"""DuckDB twins of the catalog queries.

Each SQL string runs on the driver's pre-registered table views. Fixture
views are inlined as CTEs. Every double is rounded to 6 places and every
count cast to BIGINT, matching the Spark side.
"""

from __future__ import annotations

ORACLE: dict[str, str] = {}


def sql(name: str, text: str) -> None:
    ORACLE[name] = text.strip()


def r6(expr: str) -> str:
    """6 decimals, or 11 significant digits for |x| >= 1e5 (same rule as the Spark side)."""
    x = f"CAST({expr} AS DOUBLE)"
    return (f"(CASE WHEN abs({x}) < 1e5 THEN round({x}, 6) "
            f"WHEN abs({x}) < 1e23 THEN round({x}, CAST(10 - floor(log10(abs({x}))) AS INTEGER)) "
            f"ELSE {x} END)")


def pct(num: str, den: str) -> str:
    return r6(f"CAST({num} AS DOUBLE) * 100.0 / CAST({den} AS DOUBLE)")


def tall(src: str, cols: list[str], value: str = "CAST({c} AS DOUBLE)") -> str:
    """UNION ALL unpivot of ``src`` into ``(column_name, v)``."""
    parts = [f"SELECT '{c}' AS column_name, {value.format(c=c)} AS v FROM {src}" for c in cols]
    return "\n  UNION ALL ".join(parts)


# ---------------------------------------------------------------- fixture views

DIRTY = """
dirty_b AS (
  SELECT o_orderkey, o_custkey,
    CASE WHEN o_orderkey % 17 = 0 THEN NULL
         WHEN o_orderkey % 97 = 0 THEN o_totalprice * 20.0 ELSE o_totalprice END AS price,
    CASE WHEN o_orderkey % 23 = 0 THEN NULL ELSE CAST(o_custkey % 40 AS DOUBLE) END AS tenure,
    CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_orderpriority END AS priority,
    concat('city_', CAST(o_custkey % 50 AS VARCHAR)) AS city,
    CAST(1.0 AS DOUBLE) AS const_num, 'same' AS const_str,
    CASE WHEN o_orderkey % 400 = 0 THEN 'Inactive' ELSE 'Active' END AS status,
    CASE WHEN o_orderkey % 9 = 0 THEN 1 ELSE 0 END AS target
  FROM orders),
dirty AS (SELECT * FROM dirty_b UNION ALL SELECT * FROM dirty_b WHERE o_orderkey % 50 = 0)"""

DIRTY_COLS = ["o_orderkey", "o_custkey", "price", "tenure", "priority", "city", "const_num",
              "const_str", "status", "target"]
DIRTY_NUM = ["o_orderkey", "o_custkey", "price", "tenure", "const_num"]  # target excluded
DIRTY_CAT = ["priority", "city", "const_str", "status"]

PREDS_BINARY = """
preds_binary AS (
  SELECT model, row_id, label, segment, score,
         CASE WHEN score >= 0.5 THEN 1 ELSE 0 END AS prediction
  FROM (
    SELECT m.model, e.event_id AS row_id, e.event_type AS segment,
           CASE WHEN e.value > 60 THEN 1 ELSE 0 END AS label,
           round(CAST(ascii(substr(md5(concat(CAST(e.event_id AS VARCHAR), m.model)), 1, 1)) % 10
                      AS DOUBLE) / 10.0 * 0.5
                 + CASE WHEN e.value > 60 THEN m.lift ELSE 0.0 END, 6) AS score
    FROM events e JOIN (SELECT 'm1' AS model, CAST(0.4 AS DOUBLE) AS lift
                        UNION ALL SELECT 'm2', CAST(0.1 AS DOUBLE)) m ON TRUE))"""

PREDS_MULTI = """
pm_base AS (
  SELECT vec_id AS row_id, CAST(label % 3 AS INTEGER) AS label,
         CAST(CASE WHEN ascii(substr(md5(CAST(vec_id AS VARCHAR)), 1, 1)) % 4 = 0
                   THEN (label + 1) % 3 ELSE label % 3 END AS INTEGER) AS prediction
  FROM embeddings),
pm_raw AS (
  SELECT row_id, label, prediction,
    (CAST(ascii(substr(md5(concat(CAST(row_id AS VARCHAR), ':0')), 1, 1)) % 10 AS DOUBLE) + 1.0)
      / 10.0 + CASE WHEN prediction = 0 THEN 1.0 ELSE 0.0 END AS s0,
    (CAST(ascii(substr(md5(concat(CAST(row_id AS VARCHAR), ':1')), 1, 1)) % 10 AS DOUBLE) + 1.0)
      / 10.0 + CASE WHEN prediction = 1 THEN 1.0 ELSE 0.0 END AS s1,
    (CAST(ascii(substr(md5(concat(CAST(row_id AS VARCHAR), ':2')), 1, 1)) % 10 AS DOUBLE) + 1.0)
      / 10.0 + CASE WHEN prediction = 2 THEN 1.0 ELSE 0.0 END AS s2
  FROM pm_base),
preds_multi AS (
  SELECT row_id, label, prediction,
    round(s0 / (s0 + s1 + s2), 6) AS p0, round(s1 / (s0 + s1 + s2), 6) AS p1,
    round(s2 / (s0 + s1 + s2), 6) AS p2
  FROM pm_raw)"""


# ---------------------------------------------------------------- D: issues

def _issue_ctes() -> str:
    n = "n_rows AS (SELECT count(*) AS n FROM dirty)"
    miss = "\n  UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) - count({c}) AS c FROM dirty" for c in DIRTY_COLS)
    d_missing = f"""
miss_raw AS ({miss}),
d_missing AS (
  SELECT column_name, CAST(c AS BIGINT) AS missing_count, {pct('c', 'n')} AS missing_percentage
  FROM miss_raw JOIN n_rows ON TRUE WHERE c > 0)"""
    d_outliers = f"""
num_tall AS ({tall('dirty', DIRTY_NUM)}),
fences AS (
  SELECT column_name, count(v) AS n,
         quantile_cont(v, 0.25) - 1.5 * (quantile_cont(v, 0.75) - quantile_cont(v, 0.25)) AS lo,
         quantile_cont(v, 0.75) + 1.5 * (quantile_cont(v, 0.75) - quantile_cont(v, 0.25)) AS hi
  FROM num_tall WHERE v IS NOT NULL GROUP BY column_name),
outside AS (
  SELECT t.column_name, sum(CASE WHEN t.v < f.lo OR t.v > f.hi THEN 1 ELSE 0 END) AS k
  FROM num_tall t JOIN fences f ON t.column_name = f.column_name
  WHERE t.v IS NOT NULL GROUP BY t.column_name),
d_outliers AS (
  SELECT f.column_name, CAST(o.k AS BIGINT) AS outlier_count,
         {pct('o.k', 'f.n')} AS outlier_percentage, {r6('f.lo')} AS lower_bound,
         {r6('f.hi')} AS upper_bound
  FROM fences f JOIN outside o ON f.column_name = o.column_name WHERE o.k > 0)"""
    d_imb = f"""
cls AS (SELECT CAST(target AS VARCHAR) AS class_value, count(*) AS c FROM dirty
        WHERE target IS NOT NULL GROUP BY target),
cls_s AS (SELECT min(c) AS mn, max(c) AS mx, count(*) AS k FROM cls),
d_imbalance AS (
  SELECT class_value, CAST(c AS BIGINT) AS class_count, {pct('c', 'n')} AS class_percentage,
         (k > 1 AND CAST(mn AS DOUBLE) / mx < 0.2) AS is_imbalanced,
         CASE WHEN k > 1 AND CAST(mn AS DOUBLE) / mx < 0.2
              THEN {r6('CAST(mx AS DOUBLE) / mn')} END AS imbalance_ratio
  FROM cls JOIN cls_s ON TRUE JOIN n_rows ON TRUE)"""
    card = "\n  UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(DISTINCT {c}) AS u FROM dirty" for c in DIRTY_CAT)
    d_card = f"""
card_raw AS ({card}),
d_cardinality AS (
  SELECT column_name, CAST(u AS BIGINT) AS unique_count, {pct('u', 'n')} AS unique_percentage
  FROM card_raw JOIN n_rows ON TRUE
  WHERE CAST(u AS DOUBLE) * 100.0 / n > 50 OR u > 20)"""
    feats = [c for c in DIRTY_COLS if c != "target"]
    const_parts = []
    for c in feats:
        var = f"var_samp({c})" if c in DIRTY_NUM else "CAST(NULL AS DOUBLE)"
        const_parts.append(f"SELECT '{c}' AS column_name, count(DISTINCT {c}) AS u, "
                           f"count({c}) AS nn, {var} AS var FROM dirty")
    const = "\n  UNION ALL ".join(const_parts)
    d_const = f"""
const_raw AS ({const}),
const_k AS (
  SELECT column_name, u,
    CASE WHEN var IS NOT NULL AND var < 1e-7 THEN 'constant'
         WHEN (CASE WHEN nn > 0 THEN CAST(u AS DOUBLE) / nn ELSE 0.0 END) < 0.01 AND u > 1
         THEN 'near-constant' END AS constant_type
  FROM const_raw),
d_constant AS (
  SELECT column_name, CAST(u AS BIGINT) AS unique_values, constant_type
  FROM const_k WHERE constant_type IS NOT NULL)"""
    d_dup = f"""
d_duplicates AS (
  SELECT CAST(n - d AS BIGINT) AS duplicate_count, {pct('n - d', 'n')} AS duplicate_percentage
  FROM n_rows JOIN (SELECT count(*) AS d FROM (SELECT DISTINCT * FROM dirty)) x ON TRUE)"""
    return ",".join([DIRTY, n, d_missing, d_outliers, d_imb, d_card, d_const, d_dup])


def _issue_report_body() -> str:
    def rows(src, issue, col, detail, metrics):
        return "\n  UNION ALL ".join(
            f"SELECT '{issue}' AS issue, {col} AS column_name, {detail} AS detail, "
            f"'{m}' AS metric, {r6(m)} AS value FROM {src}" for m in metrics)
    null = "CAST(NULL AS VARCHAR)"
    return "\n  UNION ALL ".join([
        rows("d_missing", "missing_values", "column_name", null,
             ["missing_count", "missing_percentage"]),
        rows("d_outliers", "outliers", "column_name", null,
             ["outlier_count", "outlier_percentage", "lower_bound", "upper_bound"]),
        rows("d_cardinality", "high_cardinality", "column_name", null,
             ["unique_count", "unique_percentage"]),
        rows("d_constant", "constant_features", "column_name", "constant_type", ["unique_values"]),
        rows("d_duplicates", "duplicate_rows", null, null,
             ["duplicate_count", "duplicate_percentage"]),
        rows("(SELECT *, CAST(is_imbalanced AS DOUBLE) AS flag FROM d_imbalance)",
             "class_imbalance", "'target'", "class_value",
             ["class_count", "class_percentage", "flag", "imbalance_ratio"]),
    ])


def _issues() -> None:
    ctes = _issue_ctes()
    for q, cte in [("q_issue_missing", "d_missing"), ("q_issue_outliers", "d_outliers"),
                   ("q_issue_imbalance", "d_imbalance"), ("q_issue_cardinality", "d_cardinality"),
                   ("q_issue_constant", "d_constant"), ("q_issue_duplicates", "d_duplicates")]:
        sql(q, f"WITH {ctes}\nSELECT * FROM {cte}")
    sql("q_issue_report", f"WITH {ctes}\n{_issue_report_body()}")
    sql("q_issue_count", f"""
WITH {ctes},
report AS ({_issue_report_body()}),
kinds AS (
  SELECT 'missing_values' AS issue, (SELECT count(*) FROM d_missing) AS n
  UNION ALL SELECT 'outliers', (SELECT count(*) FROM d_outliers)
  UNION ALL SELECT 'class_imbalance', (SELECT CASE WHEN bool_or(is_imbalanced) THEN 1 ELSE 0 END
                                       FROM d_imbalance)
  UNION ALL SELECT 'high_cardinality', (SELECT count(*) FROM d_cardinality)
  UNION ALL SELECT 'constant_features', (SELECT count(*) FROM d_constant)
  UNION ALL SELECT 'duplicate_rows', (SELECT CASE WHEN duplicate_count > 0 THEN 1 ELSE 0 END
                                      FROM d_duplicates))
SELECT issue, CAST(n AS BIGINT) AS n FROM kinds
UNION ALL SELECT 'total', CAST(sum(n) AS BIGINT) FROM kinds""")


_issues()


def _report() -> None:
    ctes = _issue_ctes()
    null = "CAST(NULL AS VARCHAR)"
    nd = "CAST(NULL AS DOUBLE)"

    def two(src, section, item, a, b):
        return (f"SELECT '{section}' AS section, concat_ws(':', {item}, 'count') AS item, "
                f"{r6(a)} AS value, {null} AS text FROM {src} UNION ALL "
                f"SELECT '{section}', concat_ws(':', {item}, 'percentage'), {r6(b)}, {null} FROM {src}")
    sql("q_report_tables", f"""
WITH {ctes},
k AS (SELECT count(DISTINCT target) AS k FROM dirty)
SELECT 'overview' AS section, 'samples' AS item, CAST(n AS DOUBLE) AS value, {null} AS text FROM n_rows
UNION ALL SELECT 'overview', 'features', {float(len(DIRTY_COLS) - 1)}, {null}
UNION ALL SELECT 'overview', 'target', {nd}, 'target'
UNION ALL SELECT 'overview', 'classes', CAST(k AS DOUBLE), {null} FROM k
UNION ALL SELECT 'overview', 'problem_type', {nd},
                 CASE WHEN k = 2 THEN 'Binary' ELSE 'Multiclass' END FROM k
UNION ALL SELECT 'overview', 'numerical_features', {float(len(DIRTY_NUM))}, {null}
UNION ALL SELECT 'overview', 'categorical_features', {float(len(DIRTY_CAT))}, {null}
UNION ALL {two('d_imbalance', 'class_distribution', 'class_value', 'class_count', 'class_percentage')}
UNION ALL {two('d_missing', 'missing_values', 'column_name', 'missing_count', 'missing_percentage')}
UNION ALL {two('d_outliers', 'outliers', 'column_name', 'outlier_count', 'outlier_percentage')}
UNION ALL SELECT 'class_imbalance', 'is_imbalanced', max(CAST(is_imbalanced AS DOUBLE)), {null}
          FROM d_imbalance
UNION ALL SELECT 'class_imbalance', 'imbalance_ratio', max(imbalance_ratio), {null} FROM d_imbalance""")


_report()


def oracle_sql() -> dict[str, str]:
    from loupe.plans import oracle_more, oracle_prep, oracle_eval  # noqa: F401  (register sections)
    return dict(ORACLE)
