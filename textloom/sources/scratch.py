"""Intermediate tables in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_path(spark: SparkSession, kind: str = "table") -> str:
    """A new path in spark.checkpoint.dir; only a local session may lack the setting."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.gettempdir() + "/textloom-scratch"
    return f"{base.rstrip('/')}/textloom-{kind}-{uuid.uuid4().hex}"


#: With this setting a query's exchanges are deleted when it ends; otherwise they stay until the driver collects garbage.
DELETE_EXCHANGES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame) -> DataFrame:
    """df, written once and read back, so that every use reads the table and none computes it again.

    The exchanges of the query that wrote it are deleted.
    """
    path, conf = scratch_path(df.sparkSession), df.sparkSession.conf
    before = conf.get(DELETE_EXCHANGES, None)
    conf.set(DELETE_EXCHANGES, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        conf.unset(DELETE_EXCHANGES) if before is None else conf.set(DELETE_EXCHANGES, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)
