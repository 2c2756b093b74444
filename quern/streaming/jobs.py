"""Streams: documents to chunks, chunks to vectors, errors to the log."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from quern.fixed import CHUNK_SCHEMA, ERROR_LOG_SCHEMA
from quern.operators.chunking import chunk_table
from quern.operators.retrieval import embed_chunks
from quern.operators.upsert import CHUNK_UPDATES
from quern.sources.tables import error_rows, require_keys
from quern.streaming import change_log

INDEX_SCHEMA = T.StructType([
    T.StructField("chunk_id", T.StringType()),
    T.StructField("content_hash", T.StringType()),
    T.StructField("tf", T.ArrayType(T.IntegerType())),
    T.StructField("embedding", T.ArrayType(T.FloatType())),
])
INDEX_UPDATES = ("content_hash", "tf", "embedding")
CHUNK_VERSIONS = ("revision",)
INDEX_VERSIONS = ("revision", "chunk_batch")
# What a chunk belongs to, and its place there: they tell which chunks a revision ends before.
PLACE = ("doc_hash", "chunk_index")
INDEX_LOG_SCHEMA = T.StructType([*INDEX_SCHEMA.fields, *(CHUNK_SCHEMA[c] for c in PLACE)])
# Incoming documents: path, text, and a revision number that orders copies of a path.
DOCUMENT_SCHEMA = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("revision", T.LongType()),
])

ONCE: Mapping[str, object] = {"availableNow": True}


def ingest_stream(
    documents: DataFrame, table: str, checkpoint: str, trigger: Mapping[str, object] = ONCE
) -> StreamingQuery:
    """A stream of (path, text, revision) becomes chunks in `table`, each row once.

    Every revision is chunked as it comes, without a shuffle, and the highest
    counts per chunk: the table is the same however the stream was cut into
    micro-batches. A path and revision come with one text. Each revision leaves a mark
    where it ends, by which chunks that it no longer has can be told.
    """

    def add(batch: DataFrame, batch_id: int) -> None:
        chunks = require_keys(chunk_table(batch, "path", "text", keep=CHUNK_VERSIONS, ends=True), "chunk_id")
        marked = chunks.withColumn(change_log.END, F.col("text_content").isNull())
        change_log.write_batch(marked, table, batch_id)

    return _start(documents, add, checkpoint, trigger)


def stream_ingest(
    spark: SparkSession,
    src: str,
    table: str,
    checkpoint: str,
    trigger: Mapping[str, object] = ONCE,
    max_files: int = 1000,
) -> StreamingQuery:
    """`ingest_stream` over the Parquet files that arrive below `src`."""
    documents = (
        spark.readStream.schema(DOCUMENT_SCHEMA).option("maxFilesPerTrigger", max_files).parquet(src)
    )
    return ingest_stream(documents, table, checkpoint, trigger)


def chunk_rows(spark: SparkSession, table: str, stale: bool = True) -> DataFrame:
    """The chunk table as `stream_ingest` has left it. Chunks that a later revision of
    their document no longer has stay, as upserts leave them, unless `stale` is false."""
    place = () if stale else PLACE
    return change_log.current(spark, table, CHUNK_SCHEMA, "chunk_id", CHUNK_UPDATES, CHUNK_VERSIONS, *place)


def compact_chunks(spark: SparkSession, table: str) -> int:
    """Merge the finished batches of a chunk log; see `change_log.compact`."""
    return change_log.compact(spark, table, CHUNK_SCHEMA, "chunk_id", CHUNK_VERSIONS, *PLACE)


def compact_index(spark: SparkSession, table: str) -> int:
    return change_log.compact(spark, table, INDEX_LOG_SCHEMA, "chunk_id", INDEX_VERSIONS, *PLACE)


def index_rows(chunks: DataFrame, versions: Sequence[str] = ()) -> DataFrame:
    """Vectors of chunks, with the hash of the text they were made from."""
    named = chunks.select(
        F.struct("chunk_id", F.md5("text_content").alias("content_hash"), *versions).alias("id"),
        "text_content",
    )
    return embed_chunks(named, "id", "text_content", arrow=True).select("id.*", "tf", "embedding")


def stream_index_sync(
    spark: SparkSession,
    src: str,
    table: str,
    checkpoint: str,
    trigger: Mapping[str, object] = ONCE,
    max_files: int = 1000,
) -> StreamingQuery:
    """Chunks that `stream_ingest` adds below `src` get their vectors in `table`.

    Of several rows of a chunk the newest counts, in whatever order they come. A batch is
    embedded as it comes, in one pass without a shuffle; marks of where revisions end go
    along, so that vectors of chunks that are gone can be left out.
    """
    chunks = (
        spark.readStream.schema(change_log.log_schema(CHUNK_SCHEMA, CHUNK_VERSIONS))
        .option("maxFilesPerTrigger", max_files)
        .parquet(src)
        .withColumnRenamed(change_log.BATCH, "chunk_batch")
    )

    def add(batch: DataFrame, batch_id: int) -> None:
        carried = [*INDEX_VERSIONS, *PLACE, change_log.END]
        change_log.write_batch(index_rows(batch, carried), table, batch_id)

    return _start(chunks, add, checkpoint, trigger)


def synced_index(spark: SparkSession, table: str) -> DataFrame:
    """The vectors of the chunks that documents have as of their newest revisions."""
    index = change_log.current(
        spark, table, INDEX_LOG_SCHEMA, "chunk_id", INDEX_UPDATES, INDEX_VERSIONS, *PLACE
    )
    return index.drop(*PLACE)


def index_resync(chunks: DataFrame, index: DataFrame) -> DataFrame:
    """The index after a full reconcile with the chunk table.

    Vectors of unchanged chunks are kept, changed and new chunks are embedded, and
    vectors without a chunk go. Only ids and hashes of the other side are moved to
    either; when few remain, Spark sends those instead of moving texts or vectors.
    """
    now = chunks.select("chunk_id", F.md5("text_content").alias("content_hash"))
    same = ["chunk_id", "content_hash"]

    def alike(a: DataFrame, b: DataFrame):
        return (a["chunk_id"] == b["chunk_id"]) & a["content_hash"].eqNullSafe(b["content_hash"])

    kept = index.join(now, alike(index, now), "left_semi").select(*INDEX_SCHEMA.fieldNames())
    then = index.select(*same)
    renew = now.join(then, alike(now, then), "left_anti").select("chunk_id")
    return kept.unionByName(index_rows(chunks.join(renew, "chunk_id", "left_semi")))


def stream_error_log(
    errors: DataFrame, path: str, checkpoint: str, trigger: Mapping[str, object] = ONCE
) -> StreamingQuery:
    """Appends a stream of (session_id, user_query, error_message) to a Parquet log.

    A `timestamp` the stream brings is kept; otherwise the clock stamps the rows.
    """
    clock = F.col("timestamp") if "timestamp" in errors.columns else None
    rows = error_rows(errors, clock).select(*ERROR_LOG_SCHEMA.fieldNames())
    return (
        rows.writeStream.format("parquet")
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .start()
    )


def _start(stream: DataFrame, add, checkpoint: str, trigger: Mapping[str, object]) -> StreamingQuery:
    return (
        stream.writeStream.foreachBatch(add)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .start()
    )
