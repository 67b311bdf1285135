"""Issue-detection queries (D1-D8) on the ``dirty_orders`` view."""

from __future__ import annotations

from loupe.operators import issues as I
from loupe.plans.catalog import register
from loupe.plans.fixtures import dirty_orders

TARGET = "target"


def _inputs(spark, sf):
    return I.IssueInputs.of(dirty_orders(spark, sf), TARGET)


@register("q_issue_missing")
def q_issue_missing(spark, sf):
    """Columns with nulls, count and % of rows."""
    return I.detect_missing(_inputs(spark, sf))


@register("q_issue_outliers")
def q_issue_outliers(spark, sf):
    """IQR outliers per numeric feature with their fences."""
    return I.detect_outliers(_inputs(spark, sf))


@register("q_issue_imbalance")
def q_issue_imbalance(spark, sf):
    """D3: class counts, % of all rows, imbalance flag and ratio."""
    return I.detect_imbalance(_inputs(spark, sf))


@register("q_issue_cardinality")
def q_issue_cardinality(spark, sf):
    """High-cardinality string features."""
    return I.detect_high_cardinality(_inputs(spark, sf))


@register("q_issue_constant")
def q_issue_constant(spark, sf):
    """Constant and near-constant features."""
    return I.detect_constant(_inputs(spark, sf))


@register("q_issue_duplicates")
def q_issue_duplicates(spark, sf):
    """Duplicate rows (equal to an earlier row)."""
    return I.detect_duplicates(dirty_orders(spark, sf))


@register("q_issue_count")
def q_issue_count(spark, sf):
    """Findings per issue kind and in total."""
    return I.issue_count(dirty_orders(spark, sf), TARGET)


@register("q_issue_report")
def q_issue_report(spark, sf):
    """The combined tall issue report."""
    return I.issue_report(dirty_orders(spark, sf), TARGET)


@register("q_report_tables")
def q_report_tables(spark, sf):
    """H1: the data report (overview, classes, missing, outliers, imbalance) as one table."""
    from loupe.operators.report import report_tables
    return report_tables(dirty_orders(spark, sf), TARGET)
