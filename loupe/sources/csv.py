"""A1 / A3: CSV ingest with pandas-style missing tokens and type inference; CSV results sink.

Quoted fields may hold separators, doubled quotes and line breaks. A file can be cut into tasks anywhere only if no
record spans lines, so one pass over the lines looks for an odd number of quotes; only
files that have one are parsed record by record, a task for each file.

Spark's CSV ``nullValue`` takes one token, while the reference's reader
treats a whole list of tokens as missing. So the file is read as strings,
the tokens are turned into NULL, and each column's type is inferred by
counting successful ``try_cast`` results in *one* aggregation; then the
columns are cast. Dates stay dates (typed), unlike the reference where they
remain text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loupe.functions.names import named

# Strings read as missing (pandas read_csv defaults).
NA_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
             "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]

_TRY_ORDER = [("bigint", T.LongType()), ("double", T.DoubleType()), ("boolean", T.BooleanType()),
              ("timestamp", T.TimestampType())]


#: A number as the reference's reader takes it; Spark's cast also takes suffixes such as ``1D``.
_NUMBER = r"^\s*[+-]?(\d+\.?\d*([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?|inf|Infinity|infinity|Inf)\s*$"


def _try(c, sql_type: str):
    if sql_type in ("bigint", "double", "int", "float"):
        return F.when(c.rlike(_NUMBER), c.try_cast(sql_type))
    if sql_type == "boolean":
        low = F.lower(F.trim(c))
        return F.when(low.isin("true", "false"), low == "true")
    if sql_type == "timestamp":
        return F.try_to_timestamp(c)
    return c.try_cast(sql_type)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None,
             na_tokens: list[str] | None = None, header: bool = True) -> DataFrame:
    """Read CSV files; missing tokens (matched as they stand) become NULL.

    Types are inferred in one pass unless a schema is given; a value that does not fit the
    schema's type raises an error that counts such values by column.
    """
    tokens = NA_TOKENS if na_tokens is None else na_tokens
    raw = spark.read.csv(path, header=header, inferSchema=False, mode="PERMISSIVE", quote='"', escape='"', multiLine=spans_lines(spark, path))
    clean = raw.select(*[F.when(named(c).isin(tokens) | named(c).isNull(), None).otherwise(named(c)).alias(c) for c in raw.columns])
    if schema is not None:
        typed = {f.name: _try(named(f.name), f.dataType.simpleString()) for f in schema.fields}
        lost = clean.agg(*[F.sum((named(c).isNotNull() & v.isNull()).cast("long")).alias(c) for c, v in typed.items()]).first().asDict()
        if any(lost.values()):
            raise ValueError(f"values that do not fit the schema: { {c: n for c, n in lost.items() if n} }")
        return clean.select(*[typed[f.name].cast(f.dataType).alias(f.name) for f in schema.fields])
    checks = []
    for i, c in enumerate(clean.columns):
        checks += [F.count(named(c)).alias(f"n{i}"), *[F.count(_try(named(c), name)).alias(f"{name}{i}") for name, _ in _TRY_ORDER]]
    stats = clean.agg(*checks).first()
    out = []
    for i, c in enumerate(clean.columns):
        chosen = next((name for name, _ in _TRY_ORDER if stats[f"n{i}"] > 0 and stats[f"{name}{i}"] == stats[f"n{i}"]), None)
        out.append((_try(named(c), chosen) if chosen else named(c)).alias(c))
    return clean.select(*out)


def spans_lines(spark: SparkSession, path: str) -> bool:
    """Whether a quoted field of the files holds a line break: some line has an odd number of quotes."""
    quotes = F.length("value") - F.length(F.regexp_replace("value", '"', ""))
    return not spark.read.text(path).where(quotes % 2 == 1).limit(1).isEmpty()


def write_results(df: DataFrame, path: str, missing: str = "N/A", single_file: bool = True) -> None:
    """A3: results as CSV with a header; missing metrics printed as ``N/A``.

    Result tables are small (one row per model); ``single_file`` gathers the finished
    rows into one part file for a user download (the work before runs in parallel),
    otherwise partitions write in parallel.
    """
    from loupe.operators.report import for_csv
    out = for_csv(df, missing)
    if single_file:
        out = out.repartition(1)
    out.write.mode("overwrite").option("header", True).csv(path)
