"""Named tables: creation, scans, appends and evenly sized output."""

from __future__ import annotations

import logging
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.fixed import ERROR_LOG_SCHEMA

log = logging.getLogger(__name__)


def table_scan(
    spark: SparkSession, name: str, where: Column | None = None, cols: Sequence[str] | None = None
) -> DataFrame:
    """A named table, filtered and projected; both reach the file scan."""
    df = spark.read.table(name)
    if where is not None:
        df = df.where(where)
    return df.select(*cols) if cols else df


def spread_scan(df: DataFrame, *keys: str) -> DataFrame:
    """A scan with at least one partition per core, for work that is heavy per row.

    A few files with large row groups would keep most cores idle. A scan that is
    already split more finely, as any large one is, stays as it is: no shuffle.
    The rows go by a hash of `keys`, so that a re-run task gets the same ones.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() > cores:
        return df
    return df.repartition(cores, *keys)


def ensure_table(
    spark: SparkSession, name: str, schema: T.StructType, fmt: str = "parquet", **options: str
) -> None:
    """Create the managed table if it is not there yet."""
    if not spark.catalog.tableExists(name):
        spark.catalog.createTable(name, source=fmt, schema=schema, **options)


def require_keys(df: DataFrame, *cols: str) -> DataFrame:
    """Fail the write when a key column holds a null; Parquet tables do not check."""
    guarded = df
    for c in cols:
        # the error travels in the value itself, so pruning cannot lose the check
        guarded = guarded.withColumn(
            c,
            F.when(F.col(c).isNotNull(), F.col(c)).otherwise(
                F.raise_error(F.lit(f"null in key column {c}")).cast(df.schema[c].dataType)
            ),
        )
    return guarded


def local_rows(spark: SparkSession, rows: Iterable[tuple], schema: T.StructType | str) -> DataFrame:
    return spark.createDataFrame(list(rows), schema)


def register_view(df: DataFrame, name: str) -> None:
    df.createOrReplaceTempView(name)


def error_rows(df: DataFrame, clock: Column | None = None) -> DataFrame:
    """Rows in the shape of the error log, stamped by `clock`."""
    stamp = F.current_timestamp() if clock is None else clock
    return df.select(
        stamp.cast("timestamp").alias("timestamp"), "session_id", "user_query", "error_message"
    )


def error_log_append(df: DataFrame, table: str, clock: Column | None = None) -> bool:
    """Append to the error log. A failed append is logged and never fails the job."""
    try:
        ensure_table(df.sparkSession, table, ERROR_LOG_SCHEMA)
        error_rows(df, clock).write.mode("append").saveAsTable(table)
        return True
    except Exception:
        log.critical("could not append to the error log %s", table, exc_info=True)
        return False


def write_sized(
    df: DataFrame, path: str, max_records: int = 5_000_000, partition_by: Sequence[str] = ()
) -> None:
    """Evenly sized Parquet files: AQE splits and joins the rebalanced partitions."""
    hinted = df.hint("rebalance", *partition_by) if partition_by else df.hint("rebalance")
    writer = hinted.write.options(maxRecordsPerFile=max_records, compression="zstd").mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
