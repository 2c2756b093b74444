"""A keyed table kept as one Parquet folder per micro-batch, and a base of older ones.

Plain Parquet has no MERGE. A micro-batch therefore only adds its own folder,
named by its id, and a batch that runs again after a failure writes that same
folder again: the table holds each batch once. Readers take, per key, the update
columns of the newest row and the other columns of the oldest, which is what the
upserts would have left. Where a format with MERGE is installed, `foreachBatch`
can call it instead.

Rows belong to a parent (chunks to their document) and have a position there. A row
marked `END` says that its revision of the parent ends before its position: rows of
earlier revisions there or further on are deleted. Marks travel in the log like other
rows, so a reader of the log, or of a log made from it, knows what is gone, in whatever
order revisions came.

`compact` merges folders of finished batches into a base: of each key its newest and its
oldest row, of each parent its newest mark. Nothing is moved or removed, and the base
counts once its name is published, so that running readers are not disturbed. Folders
up to the base are not read any more, and a batch of these that runs again changes
nothing. `clear` removes them when no reader, and no stream, needs them.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from itertools import takewhile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.sources.files import Folder
from quern.sources.tables import write_sized

BATCH = "batch_id"
#: Bytes of a row group of a batch.
ROW_GROUP = 8 << 20
END = "ends"
#: Where bases are, hidden from Spark's own listing, so that a stream of the log passes them over.
BASES = "_bases"


def write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    """Adds a batch, or puts it in place of an earlier attempt at it. One that is in the
    base already is left alone, with what it wrote."""
    if batch_id > _state(df.sparkSession, path)[0]:
        # small row groups, so that what reads a batch next can cut it up; bases have large ones
        df.write.mode("overwrite").options(**{"parquet.block.size": ROW_GROUP, "compression": "zstd"}).parquet(f"{path}/{BATCH}={batch_id}")


def log_schema(schema: T.StructType, versions: Sequence[str]) -> T.StructType:
    """The table's columns, the version columns its rows carry, the mark and the batch."""
    extra = [T.StructField(c, T.LongType()) for c in versions]
    return T.StructType([
        *schema.fields, *extra, T.StructField(END, T.BooleanType()), T.StructField(BATCH, T.LongType())])


def _state(spark: SparkSession, path: str) -> tuple[int, str | None, list[int]]:
    """The last batch in the base (-1: none), its folder, and the batches after it, up to
    the first that is not finished."""
    folder = Folder(spark, path)
    bases = sorted((int(n.split("-")[0]), n) for n in folder.names(f"{BASES}/published"))
    through, base = bases[-1] if bases else (-1, None)
    batches = sorted(int(n.split("=")[1]) for n in folder.names() if n.startswith(f"{BATCH}="))
    later = [b for b in batches if b > through]
    live = list(takewhile(lambda b: folder.exists(f"{BATCH}={b}/_SUCCESS"), later))
    return through, base, live


def rows(spark: SparkSession, path: str, schema: T.StructType, versions: Sequence[str]) -> DataFrame:
    """What is in the base and in the finished batches after it."""
    full = log_schema(schema, versions)
    _, base, live = _state(spark, path)
    out = spark.createDataFrame([], full)
    if live:
        reader = spark.read.schema(full).option("basePath", path)
        out = reader.parquet(*(f"{path}/{BATCH}={b}" for b in live)).select(*full.fieldNames())
    if base:
        merged = spark.read.schema(full).parquet(f"{path}/{BASES}/{base}")
        out = merged.unionByName(out) if live else merged
    return out


def _order(versions: Sequence[str], *values: str) -> Column:
    # the values themselves come last in the order, so that no tie is left to chance
    return F.struct(*versions, BATCH, *values)


def current(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    key: str,
    update_cols: Sequence[str],
    versions: Sequence[str],
    parent: str | None = None,
    position: str | None = None,
) -> DataFrame:
    """The table as of now; empty while nothing is written.

    Rows are ordered by their versions first and by batch second, so it does not
    matter in which batch the source happened to hand over a version. Rows of a
    key are first merged within each task. With `parent` and `position`, rows are left
    out that a newer revision of their parent ends before; else deletions are not
    looked at, as upserts alone would leave the table.
    """
    full = rows(spark, path, schema, versions)
    real = full.where(~F.coalesce(F.col(END), F.lit(False)))
    rest = [c for c in schema.fieldNames() if c != key]
    new = [c for c in rest if c in set(update_cols)]
    old = [c for c in rest if c not in set(update_cols)]
    aggs = []
    if new:
        aggs.append(F.max(_order(versions, *new)).alias("_new"))
    if old:
        aggs.append(F.min(_order(versions, *old)).alias("_old"))
    place = [] if parent is None else [c for c in (parent, position) if c != key]
    latest = F.max(_order(versions, *place)).alias("_last")
    grouped = real.groupBy(key).agg(*aggs, *([latest] if place else []))
    if place:
        ends = full.where(END).groupBy(F.col(parent).alias("_parent")).agg(
            F.max(F.struct(*versions, position)).alias("_end"))
        last = F.col("_last")
        own = F.col(key) if parent == key else last[parent]
        newer = F.struct(*(F.col("_end")[v] for v in versions)) > F.struct(*(last[v] for v in versions))
        gone = F.coalesce(newer & (last[position] >= F.col("_end")[position]), F.lit(False))
        grouped = grouped.join(ends, own.eqNullSafe(F.col("_parent")), "left").where(~gone)
    return grouped.select(
        *[
            F.col(c) if c == key else F.col("_new" if c in new else "_old")[c].alias(c)
            for c in schema.fieldNames()
        ]
    )


def compact(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    key: str,
    versions: Sequence[str],
    parent: str,
    position: str,
) -> int:
    """Merge the base and the finished batches after it into a new base; the last batch
    in it. Batches from the first unfinished one on are left out. A job that ends before
    it publishes leaves a folder that is not read; running it again is safe, and of two
    at once each publishes a base that is right."""
    through, _, live = _state(spark, path)
    if not live:
        return through
    full = rows(spark, path, schema, versions).where(F.col(BATCH) <= live[-1])
    names = log_schema(schema, versions).fieldNames()
    mark = F.coalesce(F.col(END), F.lit(False))
    values = [c for c in names if c not in (*versions, BATCH)]
    extremes = full.where(~mark).groupBy(key).agg(
        F.array_distinct(F.array(F.min(_order(versions, *values)), F.max(_order(versions, *values)))).alias("_kept"))
    ends = full.where(mark).groupBy(parent).agg(F.array(F.max(_order([*versions, position], *(c for c in values if c != position)))).alias("_kept"))
    kept = [df.select(F.explode("_kept").alias("r")).select(*(F.col("r")[c].alias(c) for c in names)) for df in (extremes, ends)]
    base = f"{live[-1]}-{uuid.uuid4().hex}"
    write_sized(kept[0].unionByName(kept[1]), f"{path}/{BASES}/{base}")
    Folder(spark, path).create(f"{BASES}/published/{base}", "")
    return live[-1]


def clear(spark: SparkSession, path: str) -> None:
    """Remove batches that are in the base, and older bases. To be called when no reader
    of an older state is left, and no stream of the log has these batches before it."""
    through, base, _ = _state(spark, path)
    folder = Folder(spark, path)
    for name in folder.names():
        if name.startswith(f"{BATCH}=") and int(name.split("=")[1]) <= through:
            folder.remove(name)
    for name in folder.names(f"{BASES}/published"):
        if name != base:
            folder.remove(f"{BASES}/published/{name}")
            folder.remove(f"{BASES}/{name}")
