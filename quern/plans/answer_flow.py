"""From questions to stored answers, for whole tables of questions at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.fixed import HISTORY_HEADING, OUTPUT_BLOCKED, SQL_FAILED
from quern.operators.cache import cache_entries, cache_lookup, cache_split, with_query_hash
from quern.operators.conversation import context_block
from quern.operators.intent import audio_manifest_check, audio_mentions, intent_rules, route
from quern.operators.responses import response_column, response_json
from quern.operators.retrieval import TOP_K, retrieval_answers, text_retrieve
from quern.operators.screening import filter_output, screen_input
from quern.operators.spread import spread_join
from quern.operators.upsert import upsert_cache
from quern.sources.stored import StoredTable


def answer_from_documents(
    questions: DataFrame, chunks: DataFrame, k: int = TOP_K, schema: DataFrame | None = None
) -> DataFrame:
    """Questions with their context and a document response. `schema`, one row with the
    text of table schemas (`schema_context`), goes into every context, after the documents.

    Without a language model the assembled context stands as the answer; a caller
    with one maps `engineered_context` to the text of `rag_content`.
    """
    found = retrieval_answers(text_retrieve(chunks, questions, k), chunks)
    asked = (
        questions.join(found, "question_id", "left")
        .withColumn("history", F.concat(F.lit(HISTORY_HEADING + "user: "), "user_query"))
        .withColumn("sql_result", F.lit(None).cast("string"))
    )
    if schema is not None:
        asked = asked.withColumn("schema_context", schema.scalar())
    blocks = context_block(asked, schema=None if schema is None else "schema_context")
    return response_json(blocks.withColumn("rag_content", F.col("engineered_context")), "rag")


def _routed_answers(
    misses: DataFrame, chunks: DataFrame, results: DataFrame, recordings: DataFrame, k: int
) -> DataFrame:
    """Adds `kind` and `final_response` to routed questions that carry `query_hash`.

    A text asked many times is looked up in the documents once.
    """
    way = F.col("route")
    asked = misses.where(way.isin("documents", "mixed")).select(F.col("query_hash").alias("question_id"), "user_query")
    found = retrieval_answers(text_retrieve(chunks, asked.distinct(), k), chunks)
    found = found.withColumnRenamed("question_id", "query_hash")
    ran = results.select("question_id", "sql_query", "tabular_result", "sql_error")
    name = F.element_at(F.split("path", "/"), -1).alias("audio_file")
    heard = recordings.groupBy(name).agg(F.min("transcription").alias("transcription"))

    table_way = way.isin("sql", "mixed")
    known = spread_join(misses, found, ["query_hash"], "left").join(ran, "question_id", "left")
    known = audio_manifest_check(audio_mentions(known, "user_query"), recordings).withColumnRenamed("error", "_audio")
    known = spread_join(known, heard, ["audio_file"], "left")
    document_way = way.isin("documents", "mixed")
    known = known.withColumn("rag_result", F.when(document_way, F.col("rag_result"))).withColumn(
        "sql_result", F.when(table_way, F.col("tabular_result")))
    if "history" not in known.columns:
        known = known.withColumn("history", F.lit(None).cast("string"))
    blocks = context_block(known)

    before, after = SQL_FAILED.split("{error}")
    failed = F.when(table_way, F.concat(F.lit(before), "sql_error", F.lit(after)))
    message = F.when(way == "voice", F.col("_audio")).otherwise(F.coalesce(failed, F.col("error")))
    text = F.col("engineered_context")
    blocks = (
        blocks.withColumn("error_message", message)
        .withColumn("summary", F.when(way == "voice", F.col("transcription")).otherwise(text))
        .withColumn("rag_content", text)
        .withColumn("synthesized_answer", text)
        .withColumn("rag_sources", F.col("sources"))
    )
    kinds = {"documents": "rag", "sql": "sql", "mixed": "mixed", "voice": "voice"}
    kind, response = F.lit("error"), response_column(blocks.columns, "error")
    for at, name in kinds.items():
        here = F.col("error_message").isNull() & (way == at)
        kind = F.when(here, name).otherwise(kind)
        response = F.when(here, response_column(blocks.columns, name)).otherwise(response)
    return blocks.withColumn("kind", kind).withColumn("final_response", response)


def answer_flow(
    questions: DataFrame,
    verdicts: DataFrame,
    cache: DataFrame,
    chunks: DataFrame,
    results: DataFrame,
    recordings: DataFrame,
    k: int = TOP_K,
) -> DataFrame:
    """(question_id, session_id, user_query, outcome, route, kind, final_response) of every question.

    Unsafe questions end as errors, known ones take the cached response, the rest go
    their route: to the documents, to the results of SQL texts (question_id, sql_query,
    tabular_result, sql_error), to both, or to the recordings (path, transcription).
    A failed SQL text, a missing recording and a context without content end as errors.
    `questions` may carry a `history`, which then heads the context. Without a language
    model the assembled context, or the transcription, stands as the answer.
    """
    cols = ["question_id", "session_id", "user_query", "outcome", "route", "kind", "final_response"]
    none = F.lit(None).cast("string")
    safe, errors = screen_input(questions, verdicts)
    hits, misses = cache_split(cache_lookup(with_query_hash(safe), cache))
    routed = route(intent_rules(misses, "user_query"))
    answers = _routed_answers(routed, chunks, results, recordings, k)
    return (
        errors.withColumns({"outcome": F.lit("blocked"), "route": none, "kind": F.lit("error")}).select(*cols)
        .unionByName(
            hits.withColumns({
                "outcome": F.lit("cached"),
                "route": none,
                "kind": F.get_json_object("cached_response", "$.response_type"),
                "final_response": F.col("cached_response"),
            }).select(*cols)
        )
        .unionByName(answers.withColumn("outcome", F.lit("answered")).select(*cols))
    )


def screened_flow(
    questions: DataFrame,
    verdicts: DataFrame,
    cache: DataFrame,
    chunks: DataFrame,
    results: DataFrame,
    recordings: DataFrame,
    output_verdicts: DataFrame,
    k: int = TOP_K,
) -> DataFrame:
    """`answer_flow` followed by the check of the responses."""
    return filter_output(
        answer_flow(questions, verdicts, cache, chunks, results, recordings, k), output_verdicts)


def cache_after(
    answered: DataFrame, cache: DataFrame | StoredTable, clock: Column | None = None
) -> DataFrame | int:
    """The cache with the new answers of a flow, or their upsert into a stored one. Errors
    and replaced responses stay out."""
    new = answered.where((F.col("outcome") == "answered") & (F.col("final_response") != OUTPUT_BLOCKED))
    return upsert_cache(cache, cache_entries(new, clock))


def errors_of(answered: DataFrame) -> DataFrame:
    """The flow's errors as rows for `error_log_append`."""
    return answered.where("kind = 'error'").select(
        "session_id", "user_query",
        F.coalesce(F.get_json_object("final_response", "$.error_message"), "final_response").alias("error_message"))
