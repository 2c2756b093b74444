"""The given tables as the operators' inputs. Every row of a table is used."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.text import strip_markup
from quern.operators.spread import spread_join
from quern.sources.tables import spread_scan

# ---- fixed values: columns of the given tables --------------------------------
COLUMNS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}

TABLES = tuple(COLUMNS)
CLOCK = dt.datetime(2026, 1, 1)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; with its columns stated, no file is opened to find them."""
    return spark.read.schema(COLUMNS[name]).parquet(f"{sf_dir}/{name}.parquet")


def discover(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """All given tables with the columns their files name."""
    return {name: spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in TABLES}


def clock(days: int = 0) -> Column:
    return F.lit((CLOCK + dt.timedelta(days=days)).isoformat(sep=" ")).cast("timestamp")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spread_scan(read(spark, sf_dir, "documents").select("doc_id", "source", "text"), "doc_id")
    return rows.select(
        "doc_id", F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"), "text"
    )


def conversation_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, text): each conversation with its turns as paragraphs."""
    turns = F.sort_array(F.collect_list(F.struct("turn", "text")))
    return read(spark, sf_dir, "conversations").groupBy("conv_id").agg(turns.alias("turns")).select(
        F.concat(F.lit("conversation/"), F.col("conv_id").cast("string")).alias("path"),
        F.array_join(F.transform("turns", lambda t: t["text"]), "\n\n").alias("text"))


def with_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("path", "text").unionByName(conversation_texts(spark, sf_dir))


def _revised(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Labelled documents come again: good ones changed, the others shorter."""
    text = F.when(F.col("quality") == 1, F.replace("text", F.lit("e"), F.lit("E"))).otherwise(
        F.replace("text", F.lit(" "), F.lit(""))
    )
    return docs.join(labels.select("doc_id", "quality"), "doc_id").select(
        "doc_id", "path", text.alias("text")
    )


def _from_pages(pages: DataFrame) -> DataFrame:
    return pages.select(
        F.concat(F.lit("pages/"), F.col("page_id").cast("string")).alias("path"),
        strip_markup(F.col("html")).alias("text"),
    )


def revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _revised(documents(spark, sf_dir), read(spark, sf_dir, "labels"))


def page_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spread_scan(read(spark, sf_dir, "pages").select("page_id", "html"), "page_id")
    return _from_pages(rows)


def streamed(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table as a stream. The glob fits one file as well as a folder of files."""
    return spark.readStream.schema(COLUMNS[name]).parquet(f"{sf_dir}/{name}.parquet*")


def document_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, text, revision): documents and pages, and labelled documents once more."""
    docs = streamed(spark, sf_dir, "documents").select(
        "doc_id", F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"), "text"
    )
    again = _revised(docs, read(spark, sf_dir, "labels")).select("path", "text")
    first, second = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")
    return (
        docs.select("path", "text", first.alias("revision"))
        .unionByName(again.withColumn("revision", second))
        .unionByName(_from_pages(streamed(spark, sf_dir, "pages")).withColumn("revision", first))
    )


def arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a second ingest brings: revised documents and pages not seen before."""
    return revisions(spark, sf_dir).select("path", "text").unionByName(page_documents(spark, sf_dir))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("string").alias("session_id"), "turn", "role", "text"
    )


def _question_id() -> Column:
    return F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        read(spark, sf_dir, "conversations")
        .where("role = 'user'")
        .select(
            _question_id().alias("question_id"),
            F.col("conv_id").cast("string").alias("session_id"),
            "conv_id",
            "turn",
            F.col("text").alias("user_query"),
        )
    )


def answered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions whose next turn is an answer."""
    answers = read(spark, sf_dir, "conversations").where("role = 'assistant'").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer")
    )
    return questions(spark, sf_dir).join(answers, ["conv_id", "turn"])


def verdict_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts as a judge would word them; two of them only contain the word."""
    toxic, good = F.col("toxic") == 1, F.col("quality") == 1
    text = (
        F.when(toxic & good, " YES. ")
        .when(toxic, "yes")
        .when(good, "No")
        .otherwise("eyes open")
    )
    return read(spark, sf_dir, "labels").select("doc_id", "quality", "toxic", text.alias("verdict"))


def question_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = verdict_texts(spark, sf_dir).select(F.col("doc_id").alias("conv_id"), "verdict")
    asked = questions(spark, sf_dir)
    return spread_join(asked, judged, ["conv_id"], "inner").select("question_id", "verdict")


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of every intent, worded from the rows of documents, events and turns."""
    doc = F.col("doc_id").cast("string")
    by_lang = (
        F.when(F.col("lang") == "en", F.concat(F.lit("Summarize the project "), "source", F.lit(" review document.")))
        .when(F.col("lang") == "fr", F.concat(F.lit("Compare 2024 vs 2023 total sales of "), "source", F.lit(".")))
        .when(F.col("lang") == "de", F.concat(F.lit("Show "), "source", F.lit(" shipments only.")))
        .otherwise(F.concat(F.lit("Summarize the "), "source", F.lit("_notes_"), doc, F.lit(".mp3 audio file.")))
    )
    kind = F.col("event_type")
    user = F.col("user_id").cast("string")
    by_event = (
        F.when(kind == "view", F.concat(F.lit("Show trend of views of user "), user, F.lit(" over time.")))
        .when(kind == "signup", F.concat(F.lit("Which reports and tables mention user "), user, F.lit("?")))
        .when(kind == "click", F.concat(F.lit("Please transcribe 'calls/"), user, F.lit(".wav' and \"b.flac\" now")))
        .when(kind == "error", F.concat(F.lit("Play NOTES"), user, F.lit(".MP3, last 6 months vs prior 6 months")))
        .otherwise(F.concat(F.lit("How much did user "), user, F.lit(" spend in n"), user, F.lit(".mp3x?")))
    )
    made = [
        read(spark, sf_dir, "documents").select(
            F.concat(F.lit("d"), doc).alias("request_id"), by_lang.alias("request")
        ),
        read(spark, sf_dir, "events").select(
            F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("request_id"),
            by_event.alias("request"),
        ),
        read(spark, sf_dir, "conversations").select(
            F.concat(F.lit("c"), _question_id()).alias("request_id"), F.col("text").alias("request")
        ),
    ]
    return made[0].unionByName(made[1]).unionByName(made[2])


def period_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All requests, and questions that compare periods, worded from customers."""
    key = F.col("c_custkey")
    year = lambda n: (1995 + n % 7).cast("string")
    text = (
        F.when(key % 4 == 0, F.concat(F.lit("Compare "), year(key), F.lit(" vs "), year(F.col("c_nationkey")), F.lit(" sales.")))
        .when(key % 4 == 1, F.concat(
            F.lit("Q"), (1 + key % 3).cast("string"), F.lit(" "), year(key), F.lit(" versus March "), year(key + 1)))
        .when(key % 4 == 2, F.concat(
            F.lit("Sales of the Last "), (1 + key % 24).cast("string"), F.lit(" months vs. previous "),
            (1 + F.col("c_nationkey") % 4).cast("string"), F.lit(" quarters?")))
        .otherwise(F.concat(F.lit("Who is "), "c_name", F.lit(" vs "), year(key)))
    )
    made = read(spark, sf_dir, "customer").select(F.concat(F.lit("k"), key.cast("string")).alias("question_id"), text.alias("user_query"))
    return requests(spark, sf_dir).select(
        F.col("request_id").alias("question_id"), F.col("request").alias("user_query")).unionByName(made)


def flow_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All requests as questions; turns belong to the session of their conversation."""
    conv = F.regexp_extract("request_id", r"^c(\d+)-", 1)
    return requests(spark, sf_dir).select(
        F.col("request_id").alias("question_id"),
        F.when(conv != "", conv).otherwise(F.col("request_id")).alias("session_id"),
        F.col("request").alias("user_query"),
    )


def sql_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL texts gave for the requests worded from events; those of errors failed."""
    failed = F.col("event_type") == "error"
    number = F.col("event_id").cast("string")
    return read(spark, sf_dir, "events").select(
        F.concat(F.lit("e"), number).alias("question_id"),
        F.concat(F.lit("SELECT value FROM events WHERE event_id = "), number).alias("sql_query"),
        F.when(~failed, F.col("value").cast("decimal(12,2)").cast("string")).alias("tabular_result"),
        F.when(failed, F.col("props")).alias("sql_error"),
    )


def recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One recording per customer, which names the customer."""
    return read(spark, sf_dir, "customer").select(
        F.concat(F.lit("/data/calls/"), F.col("c_custkey").cast("string"), F.lit(".wav")).alias("path"),
        F.col("c_name").alias("transcription"),
    )


def intent_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intent JSON, well and ill formed, worded from the rows of events and documents."""
    user = F.col("user_id").cast("string")
    kind = F.col("event_type")
    by_event = (
        F.when(
            kind == "view",
            F.concat(
                F.lit('{"intent":"DrillDown","filter_targets":["user '), user,
                F.lit('","all"],"comparison_periods":[],"visualization":false}'),
            ),
        )
        .when(
            kind == "signup",
            F.lit('{"intent":"Analytical","filter_targets":[],"comparison_periods":["2024 vs 2023"],"visualization":true}'),
        )
        .when(kind == "click", F.concat(F.lit('{"intent":'), user, F.lit("}")))
        .when(kind == "error", F.concat(F.lit("not json "), "props"))
        .otherwise(F.lit('{"intent":"Forecast","visualization":true}'))
    )
    by_lang = (
        F.when(F.col("lang") == "en", F.lit('{"intent":"Unstructured"}'))
        .when(F.col("lang") == "fr", F.lit('["Voice"]'))
        .when(F.col("lang") == "de", F.lit(""))
    )
    return (
        read(spark, sf_dir, "events")
        .select(F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("request_id"), by_event.alias("intent_json"))
        .unionByName(
            read(spark, sf_dir, "documents").select(
                F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("request_id"),
                by_lang.alias("intent_json"),
            )
        )
    )


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements over the view `quern_nation`, worded from regions and nations: with
    aliases, with a common table expression, with wrong columns, and no queries."""
    key, name = F.col("r_regionkey").cast("string"), F.col("r_name")
    worded = {
        "a": F.concat(F.lit("SELECT n.n_name AS who, count(*) AS how_many FROM quern_nation AS n WHERE n.n_regionkey = "), key,
                      F.lit(" GROUP BY who ORDER BY who")),
        "b": F.concat(F.lit("WITH own AS (SELECT n_name AS title FROM quern_nation WHERE n_regionkey = "), key,
                      F.lit(") SELECT max(own.title) AS last FROM own -- "), name),
        "c": F.concat(F.lit("SELECT n.r_name FROM quern_nation n WHERE n_regionkey = "), key),
        "d": F.concat(F.lit("WITH own AS (SELECT n_name AS title FROM quern_nation) SELECT n_name FROM own WHERE title = '"), name, F.lit("'")),
        "e": F.concat(F.lit("DROP VIEW quern_nation_"), key),
    }
    rows = read(spark, sf_dir, "region")
    made = None
    for mark, text in worded.items():
        one = rows.select(F.concat(F.lit(mark), key).alias("query_id"), text.alias("query_text"))
        made = one if made is None else made.unionByName(one)
    again = read(spark, sf_dir, "nation").select(
        F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("query_id"),
        F.concat(F.lit("b"), F.col("n_regionkey").cast("string")).alias("_like"))
    same = again.join(made.withColumnRenamed("query_id", "_like"), "_like").select("query_id", "query_text")
    return made.unionByName(same)


def query_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query texts: clean ones from parts, the free text of turns as unknown words."""
    clean = F.concat(
        F.lit("SELECT p_brand, SUM(p_size) FROM part WHERE p_name = '"), "p_name",
        F.lit("' GROUP BY p_brand -- "), "p_type", F.lit("\nLIMIT "), F.col("p_size").cast("string"),
    )
    odd = F.concat(F.lit("SELECT "), F.lower("p_type"), F.lit(" FROM part LIMIT 5"))
    parts = read(spark, sf_dir, "part")
    label = lambda mark: F.concat(F.lit(mark), F.col("p_partkey").cast("string"))
    made = [
        parts.select(label("p").alias("query_id"), clean.alias("query_text")),
        parts.select(label("q").alias("query_id"), odd.alias("query_text")),
        read(spark, sf_dir, "conversations").select(
            F.concat(F.lit("c"), _question_id()).alias("query_id"), F.col("text").alias("query_text")
        ),
    ]
    return made[0].unionByName(made[1]).unionByName(made[2])
