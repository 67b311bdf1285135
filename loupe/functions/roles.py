"""Column roles read from the schema (metadata only, no Spark job)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import types as T

NUMERIC_TYPES = (
    T.ByteType, T.ShortType, T.IntegerType, T.LongType,
    T.FloatType, T.DoubleType, T.DecimalType,
)
INTEGRAL_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FLOATING_TYPES = (T.FloatType, T.DoubleType)


def role_of(dt: T.DataType) -> str:
    """numeric | categorical | other (boolean, dates, timestamps, nested)."""
    if isinstance(dt, NUMERIC_TYPES):
        return "numeric"
    if isinstance(dt, (T.StringType, T.VarcharType, T.CharType)):
        return "categorical"
    return "other"


def type_name(dt: T.DataType) -> str:
    """Short type label used in profiles: int64 / float64 / object / bool / datetime / other."""
    if isinstance(dt, INTEGRAL_TYPES):
        return "int64"
    if isinstance(dt, (T.FloatType, T.DoubleType, T.DecimalType)):
        return "float64"
    if isinstance(dt, (T.StringType, T.VarcharType, T.CharType)):
        return "object"
    if isinstance(dt, T.BooleanType):
        return "bool"
    if isinstance(dt, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "datetime"
    return "other"


@dataclass(frozen=True)
class Roles:
    numerical: tuple[str, ...]
    categorical: tuple[str, ...]
    other: tuple[str, ...]


def column_roles(df: DataFrame, exclude: tuple[str, ...] | list[str] | str | None = None) -> Roles:
    """B1: split columns by role, in schema order, optionally excluding some (e.g. the target)."""
    if isinstance(exclude, str):
        exclude = (exclude,)
    skip = set(exclude or ())
    num, cat, oth = [], [], []
    for f in df.schema.fields:
        if f.name in skip:
            continue
        {"numeric": num, "categorical": cat, "other": oth}[role_of(f.dataType)].append(f.name)
    return Roles(tuple(num), tuple(cat), tuple(oth))
