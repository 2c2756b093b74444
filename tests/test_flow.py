"""The whole flow on rows that take every route."""

from quern import fixed
from quern.operators.chunking import chunk_table
from quern.plans import answer_flow as flow
from quern.plans import inputs as given


def _inputs(spark):
    questions = spark.createDataFrame(
        [
            ("doc", "Summarize the document on copper"),
            ("doc again", "Summarize the document on copper"),
            ("both", "Which reports and tables mention copper?"),
            ("sql", "Total sales of copper"),
            ("failed", "Total sales of iron"),
            ("nothing", "Total sales of tin"),
            ("heard", "Transcribe a.wav"),
            ("unheard", "Transcribe b.wav"),
            ("unsafe", "Total sales of lead"),
            ("replaced", "Total sales of zinc"),
        ],
        "question_id string, user_query string",
    ).selectExpr("question_id", "'s' AS session_id", "user_query")
    verdicts = spark.createDataFrame([("unsafe", "yes"), ("sql", "no")], "question_id string, verdict string")
    out_verdicts = spark.createDataFrame([("replaced", "yes")], "question_id string, verdict string")
    cache = spark.createDataFrame([], fixed.CACHE_SCHEMA)
    docs = spark.createDataFrame([("p/1", "copper is a metal"), ("p/2", "the document on copper")], "path string, text string")
    results = spark.createDataFrame(
        [("sql", "SELECT 1", "1", None), ("both", "SELECT 2", "2", None), ("failed", "SELEC", None, "syntax"),
         ("replaced", "SELECT 3", "3", None)],
        "question_id string, sql_query string, tabular_result string, sql_error string",
    )
    recordings = spark.createDataFrame([("/x/a.wav", "hello")], "path string, transcription string")
    return questions, verdicts, cache, chunk_table(docs, "path", "text"), results, recordings, out_verdicts


def test_every_route_has_its_response(spark):
    questions, verdicts, cache, *rest = _inputs(spark)
    rows = {r.question_id: r for r in flow.screened_flow(questions, verdicts, cache, *rest).collect()}
    assert {k: (r.outcome, r.kind) for k, r in rows.items()} == {
        "doc": ("answered", "rag"), "doc again": ("answered", "rag"), "both": ("answered", "mixed"),
        "sql": ("answered", "sql"), "failed": ("answered", "error"), "nothing": ("answered", "error"),
        "heard": ("answered", "voice"), "unheard": ("answered", "error"), "unsafe": ("blocked", "error"),
        "replaced": ("answered", "sql"),
    }
    assert rows["doc"].final_response == rows["doc again"].final_response
    assert fixed.DOCUMENTS_HEADING.strip() in rows["both"].final_response
    assert fixed.RESULT_HEADING.strip() in rows["both"].final_response
    assert fixed.SQL_FAILED.format(error="syntax") in rows["failed"].final_response
    assert fixed.NO_CONTEXT in rows["nothing"].final_response
    assert fixed.AUDIO_MISSING.format(name="b.wav") in rows["unheard"].final_response
    assert "hello" in rows["heard"].final_response
    assert rows["replaced"].final_response == fixed.OUTPUT_BLOCKED


def test_a_second_run_takes_answers_from_the_cache(spark):
    questions, verdicts, cache, *rest = _inputs(spark)
    first = flow.screened_flow(questions, verdicts, cache, *rest)
    kept = flow.cache_after(first, cache, given.clock())
    second = {r.question_id: r.outcome for r in flow.screened_flow(questions, verdicts, kept, *rest).collect()}
    assert {k for k, v in second.items() if v == "cached"} == {"doc", "doc again", "both", "sql", "heard"}
    messages = {r.error_message for r in flow.errors_of(first).collect()}
    assert messages == {
        fixed.INPUT_BLOCKED, fixed.NO_CONTEXT, fixed.SQL_FAILED.format(error="syntax"),
        fixed.AUDIO_MISSING.format(name="b.wav"),
    }
