"""Edge semantics of the profile and the issue rules on hand-made frames."""

import math

from pyspark.sql import functions as F

from loupe.operators import issues as I
from loupe.operators import profile as P
from loupe.operators.eda import correlation_matrix, moments, outliers_zscore

SCHEMA = "k long, num double, const_num double, const_str string, allnull double, bin int, cat string, target int"


def _frame(spark):
    rows = []
    for i in range(200):
        rows.append((i, float(i % 7) if i % 10 else None, 3.0, "same", None,
                     1 if i % 5 == 0 else 0, "a" if i % 3 else "b", i % 2))
    rows.append(rows[0])  # one duplicate row
    return spark.createDataFrame(rows, SCHEMA)


def test_missing_and_duplicates(spark):
    inp = I.IssueInputs.of(_frame(spark), "target")
    miss = {r["column_name"]: r["missing_count"] for r in I.detect_missing(inp).collect()}
    assert miss == {"num": 21, "allnull": 201}
    d = I.detect_duplicates(_frame(spark)).collect()[0]
    assert d["duplicate_count"] == 1


def test_constant_rules_compat(spark):
    inp = I.IssueInputs.of(_frame(spark), "target")
    got = {r["column_name"]: r["constant_type"] for r in I.detect_constant(inp).collect()}
    assert got.get("const_num") == "constant"
    assert "const_str" not in got      # a constant string is never flagged
    assert "allnull" not in got        # nor an all-null column
    assert got.get("bin") == "near-constant"   # 2 values on 201 rows
    assert "target" not in got


def test_binary_minority_counts_as_outliers(spark):
    inp = I.IssueInputs.of(_frame(spark), "target")
    o = {r["column_name"]: r["outlier_count"] for r in I.detect_outliers(inp).collect()}
    assert o["bin"] == 41      # IQR 0, so every 1 is outside the fences


def test_imbalance_needs_two_classes(spark):
    df = spark.createDataFrame([(1, 0)] * 20, "k long, target int")
    r = I.detect_imbalance(I.IssueInputs.of(df, "target")).collect()
    assert len(r) == 1 and r[0]["is_imbalanced"] is False


def test_nan_beside_null_counts_once(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,), (3.0,)], "x double")
    s = P.column_summary(P.value_counts_tall(df)).collect()[0]
    assert s["null_count"] == 2 and s["distinct_count"] == 2


def test_mode_ties_go_to_smallest(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), ("c",)], "s string")
    s = P.categorical_summary(df).collect()[0]
    assert s["top"] == "a" and s["freq"] == 2


def test_empty_table_gives_null_percentages(spark):
    df = spark.createDataFrame([], "x double, target int")
    assert I.detect_duplicates(df).collect()[0]["duplicate_percentage"] is None


def test_constant_column_correlation_is_null_and_moments_zero(spark):
    df = _frame(spark)
    c = {(r["col_a"], r["col_b"]): r["correlation"]
         for r in correlation_matrix(df, ["num", "const_num", "k"]).collect()}
    assert c[("const_num", "k")] is None and c[("const_num", "const_num")] is None
    assert math.isclose(c[("k", "k")], 1.0)
    m = {r["column_name"]: r for r in moments(df, ["const_num"]).collect()}
    assert m["const_num"]["skewness"] == 0.0 and m["const_num"]["kurtosis"] == 0.0
    z = {r["column_name"]: r["zscore_outliers"] for r in outliers_zscore(df, ["const_num"]).collect()}
    assert z["const_num"] == 0


def test_issue_report_has_all_sections(spark):
    rep = I.issue_report(_frame(spark), "target")
    kinds = {r[0] for r in rep.select("issue").distinct().collect()}
    assert {"missing_values", "outliers", "constant_features", "duplicate_rows",
            "class_imbalance"} <= kinds
    cnt = {r["issue"]: r["n"] for r in I.issue_count(_frame(spark), "target").collect()}
    assert cnt["total"] == sum(v for k, v in cnt.items() if k != "total")
    assert cnt["duplicate_rows"] == 1
    assert F is not None
