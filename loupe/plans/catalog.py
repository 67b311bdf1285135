"""Query catalog: name -> callable(spark, sf_dir) -> DataFrame.

Each entry runs one library operator over whole driver tables (or views that
Spark derives from them). Doubles are rounded to 6 places so the results
can be compared with the DuckDB twins in ``loupe.plans.oracle``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loupe.functions.stats import round_doubles

QueryFn = Callable[[SparkSession, str], DataFrame]
CATALOG: dict[str, QueryFn] = {}


def register(name: str):
    def deco(fn: QueryFn) -> QueryFn:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return round_doubles(fn(spark, sf_dir))
        run.__name__ = name
        run.__doc__ = fn.__doc__
        CATALOG[name] = run
        return fn
    return deco


def queries() -> dict[str, QueryFn]:
    # import side effects fill CATALOG
    from loupe.plans import q_profile, q_issues, q_eda, q_prep, q_models, q_evaluate  # noqa: F401
    return dict(CATALOG)
