"""loupe — tabular data quality, preparation and classification on Spark.

Every operator takes a DataFrame and returns a DataFrame; fitted parameters
(bounds, imputation values, category lists, scaler moments) are small
DataFrames or dicts that are applied back as Column expressions.

Subpackages
-----------
sources    CSV / Parquet ingest and result sinks
functions  Column-expression helpers (roles, statistics, hashing, ranks)
operators  profile, eda, issues, prep, split, balance, scale, models, evaluate, report
plans      fixture views over the driver tables and the query catalog
streaming  applying fitted transforms to streaming DataFrames
"""

from loupe.session import get_session, checkpoint_dir

__all__ = ["get_session", "checkpoint_dir"]
