"""Session defaults and the one place where lineage is cut."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_LOCAL_DIRS: dict[str, str] = {}


def build_session(app: str = "presswork", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the library relies on.

    Skewed joins and partition sizes are left to adaptive execution; the shuffle
    partition number is only an upper bound that AQE coalesces, so set it to two
    to three times the cluster's cores.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # call-site capture costs a JVM round trip per column expression
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def work_dir(spark: SparkSession) -> str:
    """Shared folder for staged tables: ``spark.checkpoint.dir``.

    Only a local session may run without that setting; it then gets a folder
    of its own, which later calls of the same application reuse.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    application = spark.sparkContext.applicationId
    if application not in _LOCAL_DIRS:
        _LOCAL_DIRS[application] = tempfile.mkdtemp(prefix="run-")
    return _LOCAL_DIRS[application]


def stage_path(spark: SparkSession, name: str) -> str:
    """A fresh path for a staged table."""
    return f"{work_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` once and return the written table.

    Used where a result is read more than once and is expensive to compute
    (HTML extraction, model scores, crawl levels).  A written table survives
    lost executors, cuts the lineage, and keeps column pruning for its readers.
    """
    spark = df.sparkSession
    path = stage_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """Deal a scan of few files out to ``partitions``; without a number it stays as it is."""
    return df if partitions is None else df.repartition(partitions)
