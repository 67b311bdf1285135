"""Session helpers.

On a cluster the session is created by the platform, or by ``get_session`` without any setting of its own
but those its caller names. Only local sessions (tests, benches) get the defaults below.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL_DEFAULTS = {
    "spark.sql.shuffle.partitions": "8",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.driver.memory": "16g",
}


def is_local(master: str | None) -> bool:
    """One JVM on this machine (``local-cluster`` starts executors that share no folder)."""
    return master is not None and (master == "local" or master.startswith("local["))


def get_session(master: str | None = None, app: str = "loupe", **conf) -> SparkSession:
    """The active session, or a new one.

    ``master``: the argument, else ``LOUPE_MASTER``, else what a launcher has set (``spark-submit`` tells by
    ``PYSPARK_GATEWAY_PORT``), else ``local[*]``. A local session gets ``_LOCAL_DEFAULTS`` and a scratch checkpoint folder where
    ``conf`` says nothing; on any other master only ``conf`` is set, so the cluster's own values hold, and a
    missing ``spark.checkpoint.dir`` is an error.
    """
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    launched = "PYSPARK_GATEWAY_PORT" in os.environ
    master = master or os.environ.get("LOUPE_MASTER") or (None if launched else "local[*]")
    b = SparkSession.builder.appName(app)
    settings = dict(conf)
    if master:
        b = b.master(master)
    if is_local(master):
        settings = {**_LOCAL_DEFAULTS, **conf}
        if "spark.checkpoint.dir" not in settings:
            settings["spark.checkpoint.dir"] = tempfile.mkdtemp(prefix="loupe-ckpt-")
    for k, v in settings.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by ``spark.checkpoint.dir``.

    The session's setting is always used. Where nothing is set, a local session (tests)
    gets a scratch folder; on a cluster this is an error, since a folder of one
    machine is not seen by the others.
    """
    sc = spark.sparkContext
    d = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir", None)
    if not d:
        if not is_local(sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        d = tempfile.mkdtemp(prefix="loupe-ckpt-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(d)
    return sc.getCheckpointDir() or d


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder.

    Used after expensive fitted stages so that a lost executor re-reads the
    checkpoint instead of recomputing the whole chain.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def fresh_path(spark: SparkSession, what: str) -> str:
    """A new path below the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Write a table into the shared checkpoint folder and read it back.

    Like a checkpoint, but the result has no known partitioning: a later join shuffles both
    sides, so that the skew-join rule can split a hot key.
    """
    path = fresh_path(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Most rows that one task is dealt by ``fit_rows``.
TASK_ROWS = 2_000_000


def fit_rows(df: DataFrame) -> DataFrame:
    """A training table that an iterative fit reads many times: dealt to all cores, in tasks of bounded size, and written once."""
    return materialize(df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // TASK_ROWS))))


#: Rows up to which a table that should be class- or column-sized is sent to every executor.
SMALL_ROWS = 10_000


def join_small(df: DataFrame, small: DataFrame, on: list[str], how: str = "inner", limit: int = SMALL_ROWS) -> DataFrame:
    """Join with a table that is expected to be tiny (one row per class or column).

    Its rows are counted up to ``limit`` first: a table within it is broadcast, so the facts
    are not shuffled by a key with few values; a larger one is written and joined by
    shuffling both sides, where hot keys can be split.
    """
    rows = small.limit(limit + 1).collect()
    if len(rows) <= limit:
        local = df.sparkSession.createDataFrame(rows, small.schema)
        return df.join(F.broadcast(local), on, how)
    return df.join(materialize(small), on, how)


def attach_row(df: DataFrame, row: DataFrame) -> DataFrame:
    """``df`` with the columns of ``row``, a table of exactly one row, which is sent to every task."""
    return df.withColumn("_one", F.lit(1)).join(F.broadcast(row.withColumn("_one", F.lit(1))), "_one").drop("_one")
