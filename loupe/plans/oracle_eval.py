"""DuckDB twins for the evaluation section (G)."""

from __future__ import annotations

from loupe.plans.oracle import PREDS_BINARY, PREDS_MULTI, r6, sql


def _gsel(g: list[str], alias: str = "") -> str:
    return "".join(f"{alias}{c}, " for c in g)


def per_class_ctes(src: str, g: list[str], p: str) -> str:
    """CTEs ``{p}_pc`` with per-class tp/support/predicted/n/precision/recall/f1."""
    gs = _gsel(g)
    using = ", ".join([*g, "cls"])
    part = f"PARTITION BY {', '.join(g)}" if g else ""
    return f"""
{p}_cm AS (SELECT {gs}label, prediction, count(*) AS k FROM {src} GROUP BY ALL),
{p}_cls AS (SELECT DISTINCT {gs}label AS cls FROM {p}_cm
            UNION SELECT DISTINCT {gs}prediction AS cls FROM {p}_cm),
{p}_sup AS (SELECT {gs}label AS cls, sum(k) AS support FROM {p}_cm GROUP BY ALL),
{p}_prd AS (SELECT {gs}prediction AS cls, sum(k) AS predicted FROM {p}_cm GROUP BY ALL),
{p}_tp AS (SELECT {gs}label AS cls, k AS tp FROM {p}_cm WHERE label = prediction),
{p}_base AS (
  SELECT {_gsel(g, 'c.')}c.cls, coalesce(t.tp, 0) AS tp, coalesce(s.support, 0) AS support,
         coalesce(q.predicted, 0) AS predicted
  FROM {p}_cls c LEFT JOIN {p}_sup s USING ({using}) LEFT JOIN {p}_prd q USING ({using})
  LEFT JOIN {p}_tp t USING ({using})),
{p}_m AS (
  SELECT *, sum(support) OVER ({part}) AS n,
         CASE WHEN predicted > 0 THEN CAST(tp AS DOUBLE) / predicted ELSE 0.0 END AS precision,
         CASE WHEN support > 0 THEN CAST(tp AS DOUBLE) / support ELSE 0.0 END AS recall
  FROM {p}_base),
{p}_pc AS (
  SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall)
                 ELSE 0.0 END AS f1_score
  FROM {p}_m)"""


def basic_sql(p: str, g: list[str]) -> str:
    gb = f"GROUP BY {', '.join(g)}" if g else ""
    return f"""
SELECT {_gsel(g)}{r6('CAST(sum(tp) AS DOUBLE) / sum(support)')} AS accuracy,
       {r6('sum(precision * support) / sum(support)')} AS precision,
       {r6('sum(recall * support) / sum(support)')} AS recall,
       {r6('sum(f1_score * support) / sum(support)')} AS f1_score
FROM {p}_pc {gb}"""


def mcc_sql(p: str, g: list[str]) -> str:
    gb = f"GROUP BY {', '.join(g)}" if g else ""
    return f"""
SELECT {_gsel(g)}CAST(sum(tp) AS DOUBLE) AS c, CAST(max(n) AS DOUBLE) AS s,
       sum(CAST(predicted AS DOUBLE) * support) AS pt,
       sum(CAST(predicted AS DOUBLE) * predicted) AS pp,
       sum(CAST(support AS DOUBLE) * support) AS tt
FROM {p}_pc {gb}"""


def mcc_value() -> str:
    return ("CASE WHEN (s * s - pp) * (s * s - tt) > 0 "
            "THEN (c * s - pt) / sqrt((s * s - pp) * (s * s - tt)) ELSE 0.0 END")


def cum_ctes(src: str, g: list[str], y: str, p: str) -> str:
    """CTE ``{p}_cum``: per distinct score pos/neg, before-sums and totals."""
    gs = _gsel(g)
    part = f"PARTITION BY {', '.join(g)}" if g else ""
    return f"""
{p}_sc AS (SELECT {gs}score, sum(CASE WHEN {y} = 1 THEN 1 ELSE 0 END) AS pos,
                  sum(CASE WHEN {y} = 1 THEN 0 ELSE 1 END) AS neg
           FROM {src} WHERE score IS NOT NULL GROUP BY ALL),
{p}_cum AS (
  SELECT *,
    coalesce(sum(pos) OVER ({part} ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
      AS pos_before,
    coalesce(sum(neg) OVER ({part} ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
      AS neg_before,
    sum(pos) OVER ({part}) AS pos_total, sum(neg) OVER ({part}) AS neg_total
  FROM {p}_sc)"""


def auc_sql(p: str, g: list[str]) -> str:
    gb = f"GROUP BY {', '.join(g)}" if g else ""
    return f"""
SELECT {_gsel(g)}CASE WHEN max(pos_total) > 0 AND max(neg_total) > 0
  THEN sum(pos * (neg_before + 0.5 * neg)) / (CAST(max(pos_total) AS DOUBLE) * max(neg_total))
  END AS auc
FROM {p}_cum {gb}"""


def roc_sql(p: str, g: list[str]) -> str:
    gs = _gsel(g)
    gb = f"GROUP BY {', '.join(g)}" if g else ""
    origin = (f"SELECT {gs}CAST(NULL AS DOUBLE), 0.0, 0.0 FROM {p}_cum {gb}" if g
              else "SELECT CAST(NULL AS DOUBLE), 0.0, 0.0")
    return f"""
SELECT {gs}score AS threshold,
       CASE WHEN neg_total > 0 THEN CAST(neg_total - neg_before AS DOUBLE) / neg_total END AS fpr,
       CASE WHEN pos_total > 0 THEN CAST(pos_total - pos_before AS DOUBLE) / pos_total END AS tpr
FROM {p}_cum
UNION ALL
{origin}"""


def round_all(inner: str, cols_double: list[str], cols_other: list[str]) -> str:
    sel = ", ".join([*cols_other, *[f"{r6(c)} AS {c}" for c in cols_double]])
    return f"SELECT {sel} FROM ({inner}) x"


OVR = """
ovr AS (
  SELECT 0 AS cls, CASE WHEN label = 0 THEN 1 ELSE 0 END AS y, p0 AS score FROM preds_multi
  UNION ALL SELECT 1, CASE WHEN label = 1 THEN 1 ELSE 0 END, p1 FROM preds_multi
  UNION ALL SELECT 2, CASE WHEN label = 2 THEN 1 ELSE 0 END, p2 FROM preds_multi)"""

OVO = """
ovo AS (
  SELECT 0 AS class_i, 1 AS class_j, CASE WHEN label = 1 THEN 1 ELSE 0 END AS y,
         p1 / (p0 + p1) AS score FROM preds_multi WHERE label IN (0, 1) AND p0 + p1 <> 0
  UNION ALL
  SELECT 0, 2, CASE WHEN label = 2 THEN 1 ELSE 0 END, p2 / (p0 + p2) FROM preds_multi
  WHERE label IN (0, 2) AND p0 + p2 <> 0
  UNION ALL
  SELECT 1, 2, CASE WHEN label = 2 THEN 1 ELSE 0 END, p2 / (p1 + p2) FROM preds_multi
  WHERE label IN (1, 2) AND p1 + p2 <> 0)"""

M = f"WITH {PREDS_MULTI},"
B = f"WITH {PREDS_BINARY},"

sql("q_eval_basic", f"{B}{per_class_ctes('preds_binary', ['model'], 'b')}\n"
    f"{basic_sql('b', ['model'])}")

sql("q_confusion", f"""{M}
cm AS (SELECT label, prediction, count(*) AS k FROM preds_multi GROUP BY ALL),
cls AS (SELECT label AS c FROM cm UNION SELECT prediction FROM cm)
SELECT a.c AS label, b.c AS prediction, CAST(coalesce(cm.k, 0) AS BIGINT) AS count
FROM cls a JOIN cls b ON TRUE LEFT JOIN cm ON cm.label = a.c AND cm.prediction = b.c""")

sql("q_confusion_norm", f"""{M}
cm AS (SELECT label, prediction, count(*) AS k FROM preds_multi GROUP BY ALL),
cls AS (SELECT label AS c FROM cm UNION SELECT prediction FROM cm),
g AS (SELECT a.c AS label, b.c AS prediction, coalesce(cm.k, 0) AS k
      FROM cls a JOIN cls b ON TRUE LEFT JOIN cm ON cm.label = a.c AND cm.prediction = b.c)
SELECT label, prediction, CAST(k AS BIGINT) AS count,
       {r6('CASE WHEN sum(k) OVER (PARTITION BY label) > 0 THEN CAST(k AS DOUBLE) / sum(k) OVER (PARTITION BY label) END')}
         AS rate
FROM g""")

sql("q_class_metrics", f"""{M}{per_class_ctes('preds_multi', [], 'm')}
SELECT cls, CAST(tp AS BIGINT) AS tp, CAST(predicted - tp AS BIGINT) AS fp,
       CAST(support - tp AS BIGINT) AS fn, CAST(n - support - predicted + tp AS BIGINT) AS tn,
       {r6('precision')} AS precision, {r6('recall')} AS recall, {r6('f1_score')} AS f1_score,
       CAST(support AS BIGINT) AS support
FROM m_pc""")

sql("q_mcc", f"""WITH {PREDS_MULTI}, {PREDS_BINARY},
{per_class_ctes('preds_multi', [], 'm')},
{per_class_ctes('preds_binary', ['model'], 'b')},
mm AS ({mcc_sql('m', [])}),
bm AS ({mcc_sql('b', ['model'])})
SELECT 'multi' AS model, {r6(mcc_value())} AS mcc FROM mm
UNION ALL SELECT model, {r6(mcc_value())} AS mcc FROM bm""")

sql("q_auc_binary", f"""{B}{cum_ctes('preds_binary', ['model'], 'label', 'b')}
{round_all(auc_sql('b', ['model']), ['auc'], ['model'])}""")

sql("q_auc_ovr_macro", f"""{M}{OVR},{cum_ctes('ovr', ['cls'], 'y', 'o')},
per AS ({auc_sql('o', ['cls'])})
SELECT {r6('avg(auc)')} AS auc_macro FROM per WHERE cls IN (SELECT DISTINCT label FROM preds_multi)""")

sql("q_roc_points", f"""{B}{cum_ctes('preds_binary', ['model'], 'label', 'b')}
{round_all(roc_sql('b', ['model']), ['threshold', 'fpr', 'tpr'], ['model'])}""")

sql("q_roc_ovr", f"""{M}{OVR},{cum_ctes('ovr', ['cls'], 'y', 'o')},
pts AS ({roc_sql('o', ['cls'])}),
a AS ({auc_sql('o', ['cls'])})
SELECT pts.cls, {r6('threshold')} AS threshold, {r6('fpr')} AS fpr, {r6('tpr')} AS tpr,
       {r6('a.auc')} AS auc
FROM pts JOIN a ON pts.cls = a.cls""")

sql("q_roc_micro", f"""{M}{OVR},{cum_ctes('ovr', [], 'y', 'o')},
pts AS ({roc_sql('o', [])}),
a AS ({auc_sql('o', [])})
SELECT {r6('threshold')} AS threshold, {r6('fpr')} AS fpr, {r6('tpr')} AS tpr, {r6('a.auc')} AS auc
FROM pts JOIN a ON TRUE""")

sql("q_roc_macro", f"""{M}{OVR},{cum_ctes('ovr', ['cls'], 'y', 'o')},
pts AS ({roc_sql('o', ['cls'])}),
grid AS (SELECT DISTINCT fpr AS x FROM pts),
ends AS (SELECT x, cls, max(CASE WHEN fpr <= x THEN (fpr, tpr) END) AS lo, min(CASE WHEN fpr >= x THEN (fpr, tpr) END) AS hi FROM grid JOIN pts ON TRUE GROUP BY x, cls),
mean AS (SELECT x, avg(CASE WHEN hi IS NULL OR hi[1] = lo[1] THEN lo[2] ELSE lo[2] + (hi[2] - lo[2]) * (x - lo[1]) / (hi[1] - lo[1]) END) AS y FROM ends GROUP BY x),
seg AS (SELECT x, y, (x - lag(x) OVER (ORDER BY x)) * (y + lag(y) OVER (ORDER BY x)) / 2 AS part FROM mean)
SELECT {r6('x')} AS fpr, {r6('y')} AS tpr, {r6('(SELECT sum(part) FROM seg)')} AS auc_macro FROM seg""")

sql("q_roc_ovo", f"""{M}{OVO},{cum_ctes('ovo', ['class_i', 'class_j'], 'y', 'o')}
{round_all(auc_sql('o', ['class_i', 'class_j']), ['auc'], ['class_i', 'class_j'])}""")

sql("q_roc_ovo_points", f"""{M}{OVO},{cum_ctes('ovo', ['class_i', 'class_j'], 'y', 'o')}
{round_all(roc_sql('o', ['class_i', 'class_j']), ['threshold', 'fpr', 'tpr'], ['class_i', 'class_j'])}""")

sql("q_auc_pair_matrix", f"""{M}{OVO},{cum_ctes('ovo', ['class_i', 'class_j'], 'y', 'o')},
p AS ({auc_sql('o', ['class_i', 'class_j'])}),
s AS (SELECT class_i AS class_a, class_j AS class_b, auc FROM p
      UNION ALL SELECT class_j, class_i, auc FROM p)
SELECT class_a, class_b, {r6('auc')} AS auc, {r6('avg(auc) OVER ()')} AS mean_auc,
       CAST(count(auc) OVER () / 2 AS BIGINT) AS n_pairs
FROM s""")

sql("q_classification_report", f"""{M}{per_class_ctes('preds_multi', [], 'm')}
SELECT CAST(cls AS VARCHAR) AS item, {r6('precision')} AS precision, {r6('recall')} AS recall,
       {r6('f1_score')} AS f1_score, CAST(support AS BIGINT) AS support FROM m_pc
UNION ALL SELECT 'macro avg', {r6('avg(precision)')}, {r6('avg(recall)')}, {r6('avg(f1_score)')},
       CAST(sum(support) AS BIGINT) FROM m_pc
UNION ALL SELECT 'weighted avg', {r6('sum(precision * support) / sum(support)')},
       {r6('sum(recall * support) / sum(support)')}, {r6('sum(f1_score * support) / sum(support)')},
       CAST(sum(support) AS BIGINT) FROM m_pc
UNION ALL SELECT 'accuracy', CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE),
       {r6('CAST(sum(tp) AS DOUBLE) / sum(support)')}, CAST(sum(support) AS BIGINT) FROM m_pc""")

_G = ["segment", "model"]
BOARD = f"""{B}{per_class_ctes('preds_binary', _G, 'b')},{cum_ctes('preds_binary', _G, 'label', 'c')},
bas AS ({basic_sql('b', _G).replace(r6('CAST(sum(tp) AS DOUBLE) / sum(support)'), 'CAST(sum(tp) AS DOUBLE) / sum(support)')
         .replace(r6('sum(precision * support) / sum(support)'), 'sum(precision * support) / sum(support)')
         .replace(r6('sum(recall * support) / sum(support)'), 'sum(recall * support) / sum(support)')
         .replace(r6('sum(f1_score * support) / sum(support)'), 'sum(f1_score * support) / sum(support)')}),
au AS ({auc_sql('c', _G)}),
mc AS (SELECT segment, model, {mcc_value()} AS mcc FROM ({mcc_sql('b', _G)}) z),
tm AS (SELECT 'm1' AS model, CAST(2.5 AS DOUBLE) AS training_time
       UNION ALL SELECT 'm2', CAST(0.5 AS DOUBLE)),
board AS (
  SELECT bas.segment, bas.model, accuracy, precision, recall, f1_score, au.auc, mc.mcc, tm.training_time
  FROM bas LEFT JOIN au ON bas.segment = au.segment AND bas.model = au.model
  LEFT JOIN mc ON bas.segment = mc.segment AND bas.model = mc.model
  LEFT JOIN tm ON bas.model = tm.model),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY segment ORDER BY coalesce(f1_score, -1.0) DESC,
           coalesce(auc, -1.0) DESC, coalesce(mcc, -1.0) DESC, coalesce(accuracy, -1.0) DESC,
           coalesce(training_time, 'inf'::DOUBLE) ASC, model ASC) AS rank
  FROM board)"""

_BOARD_OUT = ("segment, model, " + ", ".join(
    f"{r6(c)} AS {c}" for c in ["accuracy", "precision", "recall", "f1_score", "auc", "mcc",
                                "training_time"]))

sql("q_model_ranking", f"{BOARD}\nSELECT {_BOARD_OUT}, CAST(rank AS INTEGER) AS rank FROM ranked")
sql("q_best_model", f"{BOARD}\nSELECT {_BOARD_OUT} FROM ranked WHERE rank = 1")
sql("q_best_by_metric", f"""{BOARD},
ba AS (SELECT segment, model AS best_auc_model, auc AS best_auc,
              row_number() OVER (PARTITION BY segment ORDER BY auc DESC, model) AS r
       FROM board WHERE auc IS NOT NULL),
bm AS (SELECT segment, model AS best_mcc_model, mcc AS best_mcc,
              row_number() OVER (PARTITION BY segment ORDER BY mcc DESC, model) AS r
       FROM board WHERE mcc IS NOT NULL)
SELECT s.segment, ba.best_auc_model, {r6('ba.best_auc')} AS best_auc, bm.best_mcc_model,
       {r6('bm.best_mcc')} AS best_mcc
FROM (SELECT DISTINCT segment FROM board) s
LEFT JOIN ba ON ba.segment = s.segment AND ba.r = 1
LEFT JOIN bm ON bm.segment = s.segment AND bm.r = 1""")
