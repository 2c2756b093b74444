"""Session settings and the shared work folder."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession

# Runtime-changeable settings every job here relies on.
JOB_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # folders are listed by so many tasks at most, not by a task for each of up to 10,000
    "spark.sql.sources.parallelPartitionDiscovery.parallelism": "256",
}


def build_session(app: str = "quern", master: str | None = None, **settings) -> SparkSession:
    """A session with the settings above; `settings` use `__` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in JOB_SETTINGS.items():
        builder = builder.config(key, value)
    for key, value in settings.items():
        builder = builder.config(key.replace("__", "."), str(value))
    return builder.getOrCreate()


def apply_settings(spark: SparkSession) -> SparkSession:
    for key, value in JOB_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see: `spark.checkpoint.dir`, or where that is unset a
    folder of the warehouse, which is shared as well."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    return base or os.path.join(spark.conf.get("spark.sql.warehouse.dir"), "quern-work")


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; nothing is created."""
    return os.path.join(shared_folder(spark), f"{name}-{uuid.uuid4().hex}")


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` written to the shared folder and read back, for results used several times.

    It outlives the executors that made it and cuts the lineage.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
