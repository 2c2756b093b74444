"""One query per operator, each over whole given tables."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern import fixed
from quern.operators import (
    analytics,
    cache,
    catalog,
    chunking,
    conversation,
    intent,
    responses,
    retrieval,
    screening,
    sql_text,
    upsert,
)
from quern.plans import answer_flow as flow
from quern.plans import ingest
from quern.plans import inputs as given
from quern.plans.inputs import read
from quern.session import apply_settings, new_folder, written
from quern.operators.spread import spread_join
from quern.sources import files, tables
from quern.sources.stored import StoredTable
from quern.streaming import jobs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(apply_settings(spark), sf_dir)

    QUERIES[fn.__name__] = run
    return fn


def _money(col: str):
    """Cents as decimals: their sums do not depend on the order of the rows."""
    return F.col(col).cast("decimal(12,2)")


def _net():
    return _money("l_extendedprice") * (F.lit(1) - F.col("l_discount").cast("decimal(4,2)"))


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunk_table(given.documents(spark, sf_dir), "path", "text")


def _arrived(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunk_table(given.arrivals(spark, sf_dir), "path", "text")


# ---- sources and sinks -------------------------------------------------------

def _as_files(spark: SparkSession, sf_dir: str) -> str:
    """A folder of files: items of the benchmark and conversations as texts, pages as JSON."""
    folder = new_folder(spark, "files")
    items = read(spark, sf_dir, "benchmark").select(F.concat(F.lit("item-"), "item_id").alias("name"), "text")
    talks = given.conversation_texts(spark, sf_dir).select(F.replace("path", F.lit("/"), F.lit("-")).alias("name"), "text")
    files.write_named(items, "name", folder, "txt")
    files.write_named(talks, "name", folder, "txt", once=True)
    pages = read(spark, sf_dir, "pages").select(F.concat(F.lit("page-"), "page_id").alias("name"), "html")
    files.write_named(pages, "name", folder, "json")
    return folder


def _file_name(path: str):
    """The name that `write_named` gave a file."""
    return F.regexp_extract(path, "/name=([^/.]+)", 1).alias("name")


@query
def file_scan(spark, sf_dir):
    """Files written from given rows, scanned and read by their extension."""
    found = files.file_texts(files.file_scan(spark, f"{_as_files(spark, sf_dir)}/*", [".TXT", ".json"]))
    kind = files.extension(F.col("path"))
    text = F.when(kind == "json", F.get_json_object("text", "$.html")).otherwise(F.col("text"))
    return found.select(_file_name("path"), kind.alias("kind"), text.alias("text"), "error")


@query
def ingest_folder(spark, sf_dir):
    """The same texts as chunks of a stored table, after two runs of which one finds nothing new."""
    folder = _as_files(spark, sf_dir)
    chunks = StoredTable.create(spark, new_folder(spark, "chunk-table"), fixed.CHUNK_SCHEMA, "chunk_id")
    seen = StoredTable.create(spark, new_folder(spark, "seen"), ingest.SEEN_SCHEMA, "path")
    log = "quern_file_errors_" + new_folder(spark, "x").rsplit("-", 1)[1]
    for _ in range(2):
        ingest.ingest_folder(spark, f"{folder}/*", [".txt"], chunks, seen, log)
    return chunks.read().select(_file_name("source"), "chunk_index", "text_content")


@query
def raw_to_text(spark, sf_dir):
    pages = tables.spread_scan(read(spark, sf_dir, "pages").select("page_id", "html"), "page_id")
    return files.raw_to_text(pages, "html", "plain").select("page_id", "plain")


@query
def table_scan(spark, sf_dir):
    tables.register_view(read(spark, sf_dir, "lineitem"), "quern_lineitem")
    return tables.table_scan(
        spark,
        "quern_lineitem",
        (F.col("l_returnflag") == "R") & (F.col("l_quantity") >= 25),
        ["l_orderkey", "l_linenumber", "l_quantity"],
    )


@query
def csv_scan(spark, sf_dir):
    source = read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "n_chars")
    path = new_folder(spark, "csv")
    source.write.options(header=True, escape='"', quoteAll=True, nullValue=files.CSV_NULL).csv(path)
    return files.csv_scan(spark, path, source.schema)


@query
def error_log_append(spark, sf_dir):
    name = "quern_error_log_" + new_folder(spark, "x").rsplit("-", 1)[1]
    tables.ensure_table(
        spark, name, fixed.ERROR_LOG_SCHEMA, path=new_folder(spark, "error-log")
    )
    failed = read(spark, sf_dir, "events").where("event_type = 'error'").select(
        "event_id",
        F.col("user_id").cast("string").alias("session_id"),
        F.col("props").alias("user_query"),
        F.concat(F.lit("value "), F.col("value").cast("decimal(12,2)").cast("string")).alias("error_message"),
    )
    unsafe = given.questions(spark, sf_dir).select(
        "session_id", "user_query", F.lit(fixed.NO_CONTEXT).alias("error_message")
    )
    for batch, day in ((failed, 0), (unsafe, 1)):
        tables.error_log_append(batch, name, given.clock(day))
    return spark.read.table(name).select(
        F.date_format("timestamp", "yyyy-MM-dd").alias("day"), "session_id", "user_query", "error_message"
    )


# ---- chunking ----------------------------------------------------------------

@query
def doc_id(spark, sf_dir):
    return chunking.with_doc_id(given.documents(spark, sf_dir), "path").select("doc_id", "path", "doc_hash")


@query
def chunk_fixed(spark, sf_dir):
    return chunking.chunk_fixed(given.documents(spark, sf_dir), "path", "text")


@query
def chunk_boundary(spark, sf_dir):
    return chunking.chunk_boundary(given.documents(spark, sf_dir), "path", "text")


@query
def chunk_pieces(spark, sf_dir):
    """Chunks of whole paragraphs, lines or words, keyed."""
    return chunking.chunk_table(given.with_paragraphs(spark, sf_dir), "path", "text", pieces=True)


@query
def chunk_id(spark, sf_dir):
    chunks = chunking.chunk_fixed(given.documents(spark, sf_dir), "path", "text")
    return chunking.with_chunk_id(chunking.with_doc_id(chunks, "path")).select(
        "path", "doc_hash", "chunk_index", "chunk_id"
    )


@query
def chunk_multipart(spark, sf_dir):
    return chunking.chunk_multipart(read(spark, sf_dir, "conversations"), "conv_id", "turn", "text")


@query
def chunk_stats(spark, sf_dir):
    docs = given.documents(spark, sf_dir).withColumn("origin", F.split("path", "/")[0])
    chunks = chunking.chunk_table(docs, "path", "text", keep=("origin",))
    return chunking.chunk_stats(chunks, ["origin"])


# ---- upserts -----------------------------------------------------------------

def _chunk_store(spark: SparkSession, sf_dir: str, arrived: DataFrame) -> StoredTable:
    """A stored chunk table after the documents and then what arrives."""
    table = StoredTable.create(spark, new_folder(spark, "chunk-table"), fixed.CHUNK_SCHEMA, "chunk_id")
    for batch in (_chunks(spark, sf_dir), arrived):
        upsert.upsert_chunks(table, batch)
    return table


@query
def upsert_chunks(spark, sf_dir):
    return _chunk_store(spark, sf_dir, _arrived(spark, sf_dir)).read()


@query
def delete_chunks(spark, sf_dir):
    """The stored table without the chunks that documents no longer have."""
    arrived = written(_arrived(spark, sf_dir), "arrived")
    table = _chunk_store(spark, sf_dir, arrived)
    # what documents had, as the table's first version holds it
    table.delete(upsert.stale_chunks(table.read(table.versions()[:2][-1]), arrived))
    return table.read()


@query
def change_feed(spark, sf_dir):
    """What the arrivals do to the chunks, with digests of the texts before and after."""
    before, after = _chunks(spark, sf_dir), _arrived(spark, sf_dir)
    known = spread_join(before, after.select("doc_hash").distinct(), ["doc_hash"], "left_semi")
    feed = upsert.change_feed(known, after, "chunk_id", ["text_content"])
    digest = lambda side: F.md5(F.col(side)["text_content"]).alias(side)
    return feed.select("chunk_id", "change", digest("before"), digest("after"))


def _cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answered questions with their answers as document responses."""
    known = given.answered(spark, sf_dir).withColumnRenamed("answer", "rag_content").withColumn(
        "sources", F.array(F.concat(F.lit("conversation/"), "session_id"))
    )
    return cache.cache_entries(responses.response_json(known, "rag"), given.clock())


def _stored_cache(spark: SparkSession, sf_dir: str) -> StoredTable:
    table = StoredTable.create(spark, new_folder(spark, "cache"), fixed.CACHE_SCHEMA, "query_hash")
    upsert.upsert_cache(table, _cache(spark, sf_dir))
    return table


@query
def upsert_cache(spark, sf_dir):
    """Answers come again as SQL responses, unanswered questions as errors."""
    asked = given.questions(spark, sf_dir)
    again = given.answered(spark, sf_dir).select(
        "question_id", "session_id", "user_query", F.col("answer").alias("summary"),
        F.lit("SELECT 1").alias("sql_query"), F.lit("1").alias("tabular_result"),
    )
    failed = asked.join(again.select("question_id"), "question_id", "left_anti").withColumn(
        "error_message", F.lit(fixed.NO_CONTEXT)
    )
    system = given.turns(spark, sf_dir).where("role = 'system'").select(
        "session_id", F.col("text").alias("user_query"), F.lit("noted").alias("summary"),
        F.lit("").alias("transcription"),
    )
    cols = ["session_id", "user_query", "final_response"]
    batch = (
        responses.response_json(again, "sql").select(*cols)
        .unionByName(responses.response_json(failed, "error").select(*cols))
        .unionByName(responses.response_json(system, "voice").select(*cols))
    )
    table = _stored_cache(spark, sf_dir)
    upsert.upsert_cache(table, cache.cache_entries(batch, given.clock(1)))
    return table.read().select(
        "query_hash", "user_query", "final_response", "session_id",
        F.date_format("timestamp", "yyyy-MM-dd").alias("day"),
    )


@query
def latest_per_key(spark, sf_dir):
    events = read(spark, sf_dir, "events")
    newest = upsert.latest_per_key(events, "user_id", [F.desc("ts"), F.desc("event_id")])
    return newest.select("user_id", "event_id", "event_type", "value", "props")


@query
def changed_rows(spark, sf_dir):
    return upsert.changed_rows(
        _chunks(spark, sf_dir), _arrived(spark, sf_dir), "chunk_id", ["text_content"]
    )


@query
def stale_chunks(spark, sf_dir):
    return upsert.stale_chunks(_chunks(spark, sf_dir), _arrived(spark, sf_dir)).select(
        "chunk_id", "source", "doc_hash", "chunk_index"
    )


# ---- cache -------------------------------------------------------------------

@query
def query_hash(spark, sf_dir):
    turns = given.turns(spark, sf_dir).withColumnRenamed("text", "user_query")
    return cache.with_query_hash(turns).select("session_id", "turn", "query_hash")


def _looked_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = cache.with_query_hash(given.questions(spark, sf_dir))
    return cache.cache_lookup(asked, _cache(spark, sf_dir))


@query
def cache_lookup(spark, sf_dir):
    return _looked_up(spark, sf_dir).select("question_id", "session_id", "query_hash", "cached_response")


@query
def cache_lookup_bucketed(spark, sf_dir):
    """The same against a stored cache that is dealt by the hash of the question."""
    stored = cache.store_cache(_cache(spark, sf_dir), "quern_cache_" + new_folder(spark, "x").rsplit("-", 1)[1])
    asked = cache.with_query_hash(given.questions(spark, sf_dir))
    return cache.cache_lookup(asked, stored).select("question_id", "session_id", "query_hash", "cached_response")


@query
def cache_split(spark, sf_dir):
    hits, misses = cache.cache_split(_looked_up(spark, sf_dir))
    side = lambda df, name: df.select("question_id", F.lit(name).alias("side"))
    return side(hits, "hit").unionByName(side(misses, "miss"))


# ---- catalog -----------------------------------------------------------------

def _each(frames: dict[str, DataFrame], make) -> DataFrame:
    out = None
    for name, df in frames.items():
        one = make(df).withColumn("table_name", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


@query
def schema_inventory(spark, sf_dir):
    """The inventory beside each column's row and null counts."""
    frames = given.discover(spark, sf_dir)
    counted = _each(frames, catalog.column_counts)
    return catalog.schema_inventory(spark, frames).join(counted, ["table_name", "column_name"])


def _schema_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = given.discover(spark, sf_dir)
    filled = _each(frames, lambda df: df.agg(F.count(F.lit(1)).alias("n"))).where("n > 0")
    inventory = catalog.schema_inventory(spark, frames)
    return catalog.schema_context(inventory.join(filled.select("table_name"), "table_name", "left_semi"))


@query
def schema_context(spark, sf_dir):
    """The schema text of the tables that hold rows."""
    return _schema_text(spark, sf_dir)


@query
def table_profile(spark, sf_dir):
    return catalog.profiles(given.discover(spark, sf_dir)).select(
        "table_name", F.col("ordinal").cast("int").alias("ordinal"), "column_name",
        "n_rows", "n_nulls", "n_distinct", "min_value", "max_value",
    )


@query
def sketch_profile(spark, sf_dir):
    """Which columns' distinct counts by sketch are within five standard errors of the exact ones."""
    frames = given.discover(spark, sf_dir)
    about = _each(frames, catalog.sketch_profile)
    exact = catalog.profiles(frames).select("table_name", "column_name", "n_distinct")
    off = F.abs(F.col("about_distinct") - F.col("n_distinct"))
    return about.join(exact, ["table_name", "column_name"]).select(
        "table_name", "column_name", "n_rows", "n_nulls", (off <= 0.065 * F.col("n_distinct") + 1).alias("close"))


@query
def column_names(spark, sf_dir):
    """Names found in the markup of pages and the texts of documents."""
    pages = tables.spread_scan(read(spark, sf_dir, "pages").select("page_id", "html"), "page_id")
    texts = pages.select(
        F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("text_id"), F.col("html").alias("schema_text")
    ).unionByName(
        given.documents(spark, sf_dir).select(
            F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("text_id"), F.col("text").alias("schema_text")
        )
    )
    return catalog.column_names(texts, "schema_text", ["text_id"])


@query
def token_audit(spark, sf_dir):
    """Vocabulary: SQL words, columns and table names, and the words of the benchmark."""
    inventory = catalog.schema_inventory(spark, given.discover(spark, sf_dir))
    known = inventory.select("column_name").unionByName(
        inventory.select(F.col("table_name").alias("column_name"))
    ).unionByName(
        read(spark, sf_dir, "benchmark").select(
            F.explode(F.array_distinct(catalog.words(F.col("text")))).alias("column_name")
        )
    )
    return catalog.token_audit(
        given.query_texts(spark, sf_dir), catalog.sql_vocabulary(spark, known)
    )


RUN_SQL = """
SELECT l_suppkey, CAST(SUM(CAST(l_quantity AS DECIMAL(12, 2))) AS DOUBLE) AS total_quantity
FROM {table}
GROUP BY l_suppkey
ORDER BY total_quantity DESC, l_suppkey
"""


@query
def run_sql(spark, sf_dir):
    """The first text names a missing table; the correction supplies the right one."""
    tables.register_view(read(spark, sf_dir, "lineitem"), "quern_lineitem")
    outcome = sql_text.run_sql(
        spark, RUN_SQL.format(table="quern_missing"), lambda text, error: RUN_SQL.format(table="quern_lineitem")
    )
    if outcome.rows is None:
        raise RuntimeError(outcome.error)
    return outcome.rows


@query
def run_texts(spark, sf_dir):
    """A table of statements, each checked before it runs."""
    tables.register_view(read(spark, sf_dir, "nation"), "quern_nation")
    return sql_text.run_texts(given.statements(spark, sf_dir))


# ---- analytic shapes ---------------------------------------------------------

@query
def filter_project(spark, sf_dir):
    return analytics.filter_project(
        read(spark, sf_dir, "orders"),
        (F.col("o_orderstatus") == "F") & (F.col("o_totalprice") > 400000),
        ["o_orderkey", F.col("o_custkey").alias("account"), F.col("o_orderdate").cast("date").cast("string").alias("day")],
    )


@query
def join_inner(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey", "l_quantity"
    )
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    return analytics.join_on(lines, orders, ["o_orderkey"], "inner")


@query
def join_left(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    return analytics.join_on(docs, read(spark, sf_dir, "labels"), ["doc_id"], "left")


@query
def join_right(spark, sf_dir):
    events = read(spark, sf_dir, "events").select(F.col("user_id").alias("c_custkey"), "event_id", "event_type")
    customers = read(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return analytics.join_on(events, customers, ["c_custkey"], "right")


@query
def join_full(spark, sf_dir):
    turns = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), "turn", "role")
    return analytics.join_on(turns, read(spark, sf_dir, "labels"), ["doc_id"], "full")


@query
def agg_basic(spark, sf_dir):
    return analytics.agg_basic(
        read(spark, sf_dir, "lineitem"),
        ["l_returnflag", "l_linestatus"],
        {
            "sum_qty": F.sum(_money("l_quantity")).cast("double"),
            "sum_net": F.sum(_net()).cast("double"),
            "avg_qty": F.round(F.avg(_money("l_quantity")).cast("double"), 4),
            "n_rows": F.count(F.lit(1)),
            "min_price": F.min("l_extendedprice"),
            "max_price": F.max("l_extendedprice"),
        },
    )


@query
def top_k_on_date(spark, sf_dir):
    return analytics.top_k(
        read(spark, sf_dir, "lineitem"),
        "l_suppkey",
        F.sum(_money("l_quantity")).cast("double"),
        10,
        analytics.on_day("l_shipdate", dt.date(1998, 8, 1)),
    )


@query
def monthly_trend_join(spark, sf_dir):
    """Net sales by supplier nation and order totals by customer nation, month by month.

    Each fact is summed per key and month before it meets its dimension, so a
    partner with very many rows travels as one row per month.
    """
    nation = read(spark, sf_dir, "nation").where(F.col("n_name").ilike("%Nation_1%"))

    def fact(name: str, key: str, ts: str, measure, dim: str, dim_key: str, dim_nation: str, out: str):
        rows = read(spark, sf_dir, name).where(analytics.in_year(ts, 1997))
        monthly = analytics.trend(rows, ts, "month", {"_part": F.sum(measure)}, [key])
        place = read(spark, sf_dir, dim).join(
            nation, F.col(dim_nation) == F.col("n_nationkey")
        ).select(F.col(dim_key).alias(key), F.col("n_name").alias("partner_name"))
        return monthly.join(place, key).groupBy("partner_name", "month").agg(
            F.sum("_part").cast("double").alias(out)
        )

    sales = fact("lineitem", "l_suppkey", "l_shipdate", _net(), "supplier", "s_suppkey", "s_nationkey", "total_net_sales")
    orders = fact("orders", "o_custkey", "o_orderdate", _money("o_totalprice"), "customer", "c_custkey", "c_nationkey", "total_ordered")
    joined = analytics.trend_join(sales, orders, ["partner_name"], "month")
    return joined.withColumn("month", F.col("month").cast("string"))


@query
def trend_over_time(spark, sf_dir):
    out = analytics.trend(
        read(spark, sf_dir, "lineitem"), "l_shipdate", "month", {"quantity": F.sum(_money("l_quantity")).cast("double")}
    )
    return out.withColumn("month", F.col("month").cast("string"))


@query
def period_compare(spark, sf_dir):
    out = analytics.period_compare(
        read(spark, sf_dir, "lineitem"), "l_shipdate", ["l_suppkey"], _money("l_quantity"), 1998, 1997
    )
    return out.select(
        "l_suppkey", *[F.col(c).cast("double").alias(c) for c in ("value_a", "value_b", "difference")], "percent"
    )


@query
def rolling_compare(spark, sf_dir):
    out = analytics.rolling_compare(
        read(spark, sf_dir, "orders"), "o_orderdate", ["o_orderpriority"], _money("o_totalprice")
    )
    return out.select(
        "o_orderpriority",
        *[F.col(c).cast("double").alias(c) for c in ("recent_value", "prior_value", "difference")],
        "percent",
    )


@query
def compare_periods(spark, sf_dir):
    """From question texts to the order totals of the periods they name."""
    out = analytics.compare_periods(
        given.period_questions(spark, sf_dir), read(spark, sf_dir, "orders"), "o_orderdate", _money("o_totalprice"))
    return out.select(
        "question_id", *(F.col(c).cast("string").alias(c) for c in ("a_from", "a_to", "b_from", "b_to")),
        *(F.col(c).cast("double").alias(c) for c in ("value_a", "value_b", "difference")), "percent")


@query
def drill_down(spark, sf_dir):
    """Customers narrowed to one market segment or one named customer."""
    return analytics.drill_down(
        read(spark, sf_dir, "customer"), ["BUILDING", "Customer#000000007"], ["c_mktsegment", "c_name"]
    )


@query
def drill_down_frame(spark, sf_dir):
    """Parts narrowed to the brands that come in the largest size, named in a frame."""
    parts = read(spark, sf_dir, "part")
    targets = (
        parts.groupBy("p_brand").agg(F.max("p_size").alias("largest")).where("largest >= 50")
        .select(F.col("p_brand").alias("target"))
    )
    return analytics.drill_down(parts, targets, ["p_type", "p_brand"]).select("p_partkey", "p_brand", "p_type")


@query
def preview(spark, sf_dir):
    return sql_text.preview(
        read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), ["o_orderkey"]
    )


@query
def scalars(spark, sf_dir):
    day = F.col("o_orderdate").cast("date")
    return read(spark, sf_dir, "orders").select(
        "o_orderkey",
        day.cast("string").alias("day"),
        F.date_trunc("month", day).cast("date").cast("string").alias("month"),
        F.year(day).cast("int").alias("year"),
        F.col("o_orderpriority").ilike("%urgent%").alias("urgent"),
    )


# ---- embedding and retrieval -------------------------------------------------

@query
def embed_chunks(spark, sf_dir):
    embedded = retrieval.embed_chunks(_chunks(spark, sf_dir), "chunk_id", "text_content")
    return retrieval.sparse_terms(embedded, "chunk_id")


def _vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), "embedding")


@query
def vector_topk(spark, sf_dir):
    return retrieval.vector_topk(
        read(spark, sf_dir, "embeddings"), _vector_queries(spark, sf_dir)
    )


@query
def vector_topk_lsh(spark, sf_dir):
    return retrieval.vector_topk_lsh(
        read(spark, sf_dir, "embeddings"), _vector_queries(spark, sf_dir)
    )


def _retrieved(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    chunks = _chunks(spark, sf_dir)
    return retrieval.text_retrieve(chunks, given.questions(spark, sf_dir)), chunks


@query
def text_retrieve(spark, sf_dir):
    return _retrieved(spark, sf_dir)[0]


@query
def retrieval_context(spark, sf_dir):
    return retrieval.retrieval_context(*_retrieved(spark, sf_dir))


@query
def retrieval_sources(spark, sf_dir):
    found = retrieval.retrieval_sources(*_retrieved(spark, sf_dir))
    return found.select("question_id", F.array_join("sources", ",").alias("sources"))


# ---- conversations and contexts ----------------------------------------------

@query
def history_append(spark, sf_dir):
    """Events of a user are new turns of the session of that number."""
    events = read(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("session_id"),
        F.col("event_id").alias("turn"),
        F.lit("event").alias("role"),
        F.col("event_type").alias("text"),
    )
    return conversation.history_append(given.turns(spark, sf_dir), events)


@query
def history_text(spark, sf_dir):
    return conversation.history_text(given.turns(spark, sf_dir))


@query
def context_block(spark, sf_dir):
    """Per document number: that session's history, the text if rated good, its user's event counts."""
    key = F.col("doc_id").cast("string").alias("session_id")
    docs = given.documents(spark, sf_dir).select("doc_id", "text")
    good = read(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    texts = docs.join(good, "doc_id").select(key, F.col("text").alias("rag_result"))
    counts = read(spark, sf_dir, "events").groupBy(
        F.col("user_id").cast("string").alias("session_id"), "event_type"
    ).agg(F.count(F.lit(1)).alias("n"))
    results = sql_text.result_text(counts, ["session_id"], ["event_type"])
    base = (
        docs.select(key)
        .join(conversation.history_text(given.turns(spark, sf_dir)), "session_id", "left")
        .join(texts, "session_id", "left")
        .join(results, "session_id", "left")
    )
    return conversation.context_block(base).select("session_id", "engineered_context", "error")


@query
def prompt_render(spark, sf_dir):
    known = given.answered(spark, sf_dir)
    return conversation.prompt_render(
        known, fixed.ANSWER_TEMPLATE, {"user_query": "user_query", "engineered_context": "answer"}, "prompt"
    ).select("question_id", "prompt")


# ---- intents -----------------------------------------------------------------

def _intent_columns(df: DataFrame) -> DataFrame:
    return df.select(
        "request_id",
        "intent",
        F.array_join("filter_targets", "|").alias("filter_targets"),
        F.array_join("comparison_periods", "|").alias("comparison_periods"),
        "visualization",
    )


@query
def intent_parse(spark, sf_dir):
    return _intent_columns(intent.intent_parse(given.intent_texts(spark, sf_dir), "intent_json"))


@query
def intent_rules(spark, sf_dir):
    return _intent_columns(intent.intent_rules(given.requests(spark, sf_dir), "request"))


@query
def route(spark, sf_dir):
    parsed = intent.intent_parse(given.intent_texts(spark, sf_dir), "intent_json")
    return intent.route(parsed).select("request_id", "intent", "known_intent", "route")


@query
def audio_mentions(spark, sf_dir):
    return intent.audio_mentions(given.requests(spark, sf_dir), "request").select("request_id", "audio_file")


@query
def audio_manifest_check(spark, sf_dir):
    """Files on hand: one recording per customer."""
    mentioned = intent.audio_mentions(given.requests(spark, sf_dir), "request")
    on_hand = read(spark, sf_dir, "customer").select(
        F.concat(F.lit("/data/calls/"), F.col("c_custkey").cast("string"), F.lit(".wav")).alias("path")
    )
    return intent.audio_manifest_check(mentioned, on_hand).select(
        "request_id", "audio_file", "audio_present", "error"
    )


# ---- screening and responses -------------------------------------------------

@query
def verdict_parse(spark, sf_dir):
    judged = given.verdict_texts(spark, sf_dir)
    strict = screening.is_safe(F.col("verdict"), strict=True)
    return screening.verdict_parse(judged, "verdict").select("doc_id", "safe", strict.alias("safe_strict"))


@query
def screen_input(spark, sf_dir):
    passed, errors = screening.screen_input(
        given.questions(spark, sf_dir), given.question_verdicts(spark, sf_dir)
    )
    return passed.select("question_id", F.lit(None).cast("string").alias("final_response")).unionByName(
        errors.select("question_id", "final_response")
    )


@query
def filter_output(spark, sf_dir):
    """Documents as responses, judged by their labels."""
    docs = given.documents(spark, sf_dir).select("doc_id", F.col("text").alias("final_response"))
    return screening.filter_output(docs, given.verdict_texts(spark, sf_dir), key="doc_id")


def _all_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every kind of response, from the rows of documents, questions and parts."""
    docs = read(spark, sf_dir, "documents").select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("response_id"),
        F.col("source").alias("session_id"),
        F.col("lang").alias("user_query"),
        F.col("text").alias("rag_content"),
        F.array("source", "lang").alias("sources"),
    )
    parts = read(spark, sf_dir, "part").select(
        F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("response_id"),
        F.col("p_brand").alias("session_id"),
        F.col("p_name").alias("user_query"),
        F.col("p_type").alias("summary"),
        F.lit("SELECT p_type FROM part").alias("sql_query"),
        F.concat_ws("\n", "p_name", "p_brand").alias("tabular_result"),
    )
    known = given.answered(spark, sf_dir)
    mixed = known.select(
        F.concat(F.lit("m"), "question_id").alias("response_id"), "session_id", "user_query",
        F.col("answer").alias("synthesized_answer"), F.array("session_id").alias("rag_sources"),
        F.lit("SELECT 1").alias("sql_query"),
    )
    failed = given.questions(spark, sf_dir).select(
        F.concat(F.lit("x"), "question_id").alias("response_id"), "session_id", "user_query",
        F.lit(fixed.NO_CONTEXT).alias("error_message"),
    )
    voice = known.select(
        F.concat(F.lit("v"), "question_id").alias("response_id"), "session_id", "user_query",
        F.col("user_query").alias("summary"), F.col("answer").alias("transcription"),
    )
    made = [(docs, "rag"), (parts, "sql"), (mixed, "mixed"), (failed, "error"), (voice, "voice")]
    out = None
    for df, kind in made:
        one = responses.response_json(df, kind).select("response_id", "final_response")
        out = one if out is None else out.unionByName(one)
    return out


@query
def response_json(spark, sf_dir):
    return _all_responses(spark, sf_dir)


@query
def response_parse(spark, sf_dir):
    """Counts per kind of the parsed responses."""
    parsed = responses.response_parse(_all_responses(spark, sf_dir), "final_response")
    return parsed.groupBy("response_type").agg(
        F.count(F.lit(1)).alias("n"),
        F.count("sources").alias("with_sources"),
        F.count("sql_query").alias("with_sql"),
        F.count("suggested_fix").alias("with_fix"),
        F.sum(F.length(F.coalesce("rag_content", "synthesized_answer", "summary", "error_message")))
        .cast("bigint").alias("characters"),
    )


# ---- streams -----------------------------------------------------------------

def _run(stream) -> None:
    stream.awaitTermination()


def _ingested(spark: SparkSession, sf_dir: str) -> str:
    """Documents, their revisions and pages streamed into a chunk table; its path."""
    table = new_folder(spark, "chunks")
    _run(jobs.ingest_stream(given.document_stream(spark, sf_dir), table, new_folder(spark, "checkpoint")))
    return table


@query
def stream_ingest(spark, sf_dir):
    return jobs.chunk_rows(spark, _ingested(spark, sf_dir))


@query
def stream_compact(spark, sf_dir):
    """The chunk table after its batches have been merged."""
    table = _ingested(spark, sf_dir)
    jobs.compact_chunks(spark, table)
    return jobs.chunk_rows(spark, table)


@query
def stream_index_sync(spark, sf_dir):
    """Vectors of the chunks that documents have as of their last revision."""
    chunks, index = _ingested(spark, sf_dir), new_folder(spark, "index")
    _run(jobs.stream_index_sync(spark, chunks, index, new_folder(spark, "checkpoint")))
    synced = jobs.synced_index(spark, index)
    return retrieval.sparse_terms(synced, "chunk_id").drop("weight")


@query
def index_resync(spark, sf_dir):
    """The index of the documents, brought to the chunks after the upsert."""
    before = written(_chunks(spark, sf_dir), "chunks")
    old = written(jobs.index_rows(before), "index")
    now = written(upsert.upsert_chunks(before, _arrived(spark, sf_dir)), "chunks")
    return retrieval.sparse_terms(jobs.index_resync(now, old), "chunk_id").drop("weight")


@query
def stream_error_log(spark, sf_dir):
    errors = given.streamed(spark, sf_dir, "events").where("event_type = 'error'").select(
        F.col("ts").cast("timestamp").alias("timestamp"),
        F.col("user_id").cast("string").alias("session_id"),
        F.col("props").alias("user_query"),
        F.col("event_type").alias("error_message"),
    )
    path = new_folder(spark, "error-stream")
    _run(jobs.stream_error_log(errors, path, new_folder(spark, "checkpoint")))
    return spark.read.schema(fixed.ERROR_LOG_SCHEMA).parquet(path).select(
        F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("at"), "session_id", "user_query", "error_message"
    )


# ---- whole flows -------------------------------------------------------------

@query
def answer_questions(spark, sf_dir):
    """Every user question answered from the best chunks of all documents."""
    answers = flow.answer_from_documents(given.questions(spark, sf_dir), _chunks(spark, sf_dir))
    return answers.select("question_id", "engineered_context", "final_response")


@query
def answer_with_schema(spark, sf_dir):
    """The same with the schemas of the tables beside the documents."""
    answers = flow.answer_from_documents(
        given.questions(spark, sf_dir), _chunks(spark, sf_dir), schema=_schema_text(spark, sf_dir))
    return answers.select("question_id", "engineered_context", "final_response")


def _flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = given.verdict_texts(spark, sf_dir)
    label = lambda number: F.concat(F.lit("d"), number.cast("string")).alias("question_id")
    verdicts = judged.select(label(F.col("doc_id")), "verdict")
    # the responses are judged by the verdict of the next-numbered document
    out_verdicts = judged.select(label(F.col("doc_id") - 1), "verdict")
    return flow.screened_flow(
        given.flow_questions(spark, sf_dir), verdicts, _cache(spark, sf_dir), _chunks(spark, sf_dir),
        given.sql_results(spark, sf_dir), given.recordings(spark, sf_dir), out_verdicts,
    )


@query
def answer_flow(spark, sf_dir):
    """Screening, cache, the answer of each route and output check in one plan."""
    return _flow(spark, sf_dir).drop("user_query")


@query
def answer_flow_cache(spark, sf_dir):
    """The cache after the flow, its answers and errors: by kind of response."""
    answered, table = written(_flow(spark, sf_dir), "answers"), _stored_cache(spark, sf_dir)
    flow.cache_after(answered, table, given.clock(1))
    kept = table.read().select(
        F.lit("cache").alias("place"), "query_hash", F.get_json_object("final_response", "$.response_type").alias("detail"))
    failed = flow.errors_of(answered).select(
        F.lit("errors").alias("place"), F.md5("user_query").alias("query_hash"), F.col("error_message").alias("detail"))
    return kept.unionByName(failed)
