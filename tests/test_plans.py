"""Plan shapes every query must keep."""

import pytest

from quern.plans.queries import QUERIES

STREAMS = {"stream_ingest", "stream_index_sync", "stream_error_log", "index_resync"}
WITH_PYTHON = {"chunk_pieces", "file_scan", "answer_with_schema", 
    "vector_topk", "vector_topk_lsh", "text_retrieve", "retrieval_context", "retrieval_sources",
    "answer_questions", "answer_flow",
}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - STREAMS))
def test_no_pairs_and_no_stray_python(spark, small_dir, plan, name):
    text = plan(QUERIES[name](spark, small_dir))
    assert "CartesianProduct" not in text and "NestedLoopJoin" not in text
    python = [w for w in ("InArrow", "InPandas", "EvalPython", "ArrowEval") if w in text]
    assert bool(python) == (name in WITH_PYTHON)


@pytest.mark.parametrize(
    "name,pushed,schema",
    [
        ("table_scan", "GreaterThanOrEqual(l_quantity,25", "struct<l_orderkey:bigint,l_linenumber:int,l_quantity:double,l_returnflag:string>"),
        ("period_compare", "LessThan(l_shipdate", "struct<l_suppkey:bigint,l_quantity:double,l_shipdate:timestamp_ntz>"),
        ("top_k_on_date", "GreaterThanOrEqual(l_shipdate", "struct<l_suppkey:bigint,l_quantity:double,l_shipdate:timestamp_ntz>"),
        ("monthly_trend_join", "GreaterThanOrEqual(o_orderdate", "struct<o_custkey:bigint,o_totalprice:double,o_orderdate:timestamp_ntz>"),
        ("filter_project", "EqualTo(o_orderstatus,F)", "struct<o_orderkey:bigint,o_custkey:bigint,o_orderstatus:string,o_totalprice:double,o_orderdate:timestamp_ntz>"),
        ("drill_down", "In(c_mktsegment", "struct<c_custkey:bigint,c_name:string,c_nationkey:int,c_acctbal:double,c_mktsegment:string>"),
    ],
)
def test_filters_and_columns_reach_the_files(spark, small_dir, plan, name, pushed, schema):
    text = plan(QUERIES[name](spark, small_dir))
    assert pushed in text, text
    assert schema in text, text


def test_facts_are_summed_before_they_meet_their_dimension(spark, small_dir, plan):
    text = plan(QUERIES["monthly_trend_join"](spark, small_dir))
    scan = text.index("l_shipdate", text.index("FileScan"))
    above = text[:scan]
    assert above.rindex("HashAggregate") > above.rindex("Join [")


def test_whole_file_statistics_serve_the_newest_month(spark, small_dir, plan):
    text = plan(QUERIES["rolling_compare"](spark, small_dir))
    assert "Subquery" in text and "SortMergeJoin" not in text
