"""What the operators of this subpackage share: input tables, batches, saved steps."""

from __future__ import annotations

import gc
import time
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.session import apply_settings, new_folder

#: Rows handed to Python at once. Texts may be very long, so a batch is kept short.
BATCH_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def prepared(spark: SparkSession) -> SparkSession:
    """The session with the settings every operator here relies on."""
    apply_settings(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def body(text: Column) -> Column:
    """A text as its UTF-8 bytes, null as none: Python then neither decodes nor encodes."""
    return F.coalesce(text.cast("string"), F.lit("")).cast("binary")


class Saved:
    """`df` written below `spark.checkpoint.dir` and read back.

    It outlives the executors that made it and cuts the lineage. `drop` removes the
    files once nothing reads them any more.
    """

    def __init__(self, df: DataFrame, name: str, codec: str = "snappy"):
        self.spark = df.sparkSession
        self.path = new_folder(self.spark, f"llm-{name}")
        df.write.option("compression", codec).parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        remove(self.spark, [self.path])


def remove(spark: SparkSession, paths: Iterable[str]) -> None:
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def settle(spark: SparkSession) -> None:
    """Have the shuffle files of finished steps removed now.

    Spark removes them once the driver's garbage collector has found their plans dead,
    which an idle driver may put off until the disks are full. The first collection
    frees the plans, the second what they held; the removal itself goes on meanwhile.
    """
    for _ in range(2):
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(1)
