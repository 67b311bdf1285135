"""Columns by name, whatever the name holds.

``F.col("Sepal.Length")`` looks for a field of a struct. Every operator that is given names refers to them by
:func:`named`, so that dots, blanks and backticks are part of a name.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def quoted(name: str) -> str:
    """The name as Spark's parser takes it."""
    return "`" + name.replace("`", "``") + "`"


def named(name: str) -> Column:
    """The column with exactly this name."""
    return F.col(quoted(name))


def all_named(names: Sequence[str | Column]) -> list[Column]:
    """:func:`named` of every name; columns stay as they are."""
    return [n if isinstance(n, Column) else named(n) for n in names]
