import datetime as dt
import hashlib

from pyspark.sql import functions as F

from quern.operators import cache, upsert
from quern.plans.inputs import clock

SCHEMA = "key string, a string, b string"


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_update_keep_insert(spark):
    target = spark.createDataFrame([("1", "a1", "b1"), ("2", "a2", "b2"), ("3", "a3", "b3")], SCHEMA)
    batch = spark.createDataFrame([("2", "A2", "B2"), ("3", None, "B3"), ("4", "A4", None)], SCHEMA)
    once = upsert.upsert(target, batch, "key", ["a"])
    expected = [("1", "a1", "b1"), ("2", "A2", "b2"), ("3", None, "b3"), ("4", "A4", None)]
    assert rows(once) == expected
    assert rows(upsert.upsert(once, batch, "key", ["a"])) == expected


def test_latest_per_key_limits_before_the_shuffle(spark, plan):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 3, "y"), ("a", 3, "w"), ("b", 2, "z")], "k string, t int, v string")
    newest = upsert.latest_per_key(df, "k", [F.desc("t"), F.asc("v")])
    assert rows(newest) == [("a", 3, "w"), ("b", 2, "z")]
    text = plan(newest)
    assert text.index("WindowGroupLimit") < text.index("Exchange") < text.rindex("WindowGroupLimit")


def test_changed_rows_tells_null_from_empty(spark):
    target = spark.createDataFrame([("1", ""), ("2", None), ("3", "same"), ("5", None)], "k string, v string")
    batch = spark.createDataFrame([("1", None), ("2", None), ("3", "same"), ("4", None), ("5", "new")], "k string, v string")
    got = dict(rows(upsert.changed_rows(target, batch, "k", ["v"])))
    assert got == {"1": "update", "2": "unchanged", "3": "unchanged", "4": "insert", "5": "update"}


def test_change_feed_tells_all_kinds(spark):
    schema = "k string, v string, w string"
    before = spark.createDataFrame([("1", "a", "x"), ("2", None, "x"), ("3", "c", "x"), ("4", "d", "x")], schema)
    after = spark.createDataFrame([("1", "a", "y"), ("2", "", "y"), ("4", None, "y"), ("5", None, "y")], schema)
    got = {r["k"]: (r["change"], r["before"], r["after"]) for r in upsert.change_feed(before, after, "k", ["v"]).collect()}
    assert {k: (c, b and b["v"], a and a["v"]) for k, (c, b, a) in got.items()} == {
        "2": ("update", None, ""), "3": ("delete", "c", None), "4": ("update", "d", None), "5": ("insert", None, None)}
    assert got["5"][2] is not None and got["5"][1] is None


def test_query_hash_is_case_and_blank_sensitive(spark):
    texts = ["Wie groß?", "wie groß?", "Wie groß? "]
    df = spark.createDataFrame([(t,) for t in texts], "user_query string")
    got = [r["query_hash"] for r in cache.with_query_hash(df).collect()]
    assert got == [hashlib.md5(t.encode()).hexdigest() for t in texts]


def test_lookup_hits_and_misses(spark):
    entries = cache.cache_entries(
        spark.createDataFrame(
            [("q1", "r1", "s"), ("q2", "", "s"), ("q3", None, "s"), ("q1", "r0", "t")],
            "user_query string, final_response string, session_id string",
        ),
        clock(),
    )
    assert entries.count() == 3
    asked = cache.with_query_hash(
        spark.createDataFrame(
            [(i, q, "me") for i, q in enumerate(["q1", "q1", "q2", "q3", "q4", None])],
            "question_id int, user_query string, session_id string",
        )
    )
    found = cache.cache_lookup(asked, entries)
    hits, misses = cache.cache_split(found)
    assert {r["question_id"]: r["cached_response"] for r in hits.collect()} == {0: "r1", 1: "r1"}
    assert hits.count() + misses.count() == 6
    assert {r["session_id"] for r in found.collect()} == {"me"}


def test_error_responses_are_not_cached_unless_wanted(spark):
    empty = spark.createDataFrame([], "query_hash string, user_query string, final_response string, session_id string, timestamp timestamp")
    batch = spark.createDataFrame(
        [("h1", "q", '{"response_type":"error"}', "s", dt.datetime(2026, 1, 1)), ("h2", "q", "plain text", "s", dt.datetime(2026, 1, 1))],
        empty.schema,
    )
    assert [r["query_hash"] for r in upsert.upsert_cache(empty, batch).collect()] == ["h2"]
    assert upsert.upsert_cache(empty, batch, keep_errors=True).count() == 2


def test_lookup_filter_reaches_the_files(spark, plan, tmp_path):
    path = str(tmp_path / "cache")
    spark.createDataFrame([("h", "q", "r", "s")], "query_hash string, user_query string, final_response string, session_id string").write.parquet(path)
    stored = spark.read.parquet(path)
    text = plan(stored.where("query_hash = 'h'").select("final_response"))
    assert "EqualTo(query_hash,h)" in text and "ReadSchema: struct<query_hash:string,final_response:string>" in text


def test_a_bucketed_cache_stays_where_it_is(spark, plan):
    rows = [(hashlib.md5(f"q{i}".encode()).hexdigest(), f"q{i}", f"a{i}", "s", None) for i in range(50)]
    made = spark.createDataFrame(rows, "query_hash string, user_query string, final_response string, session_id string, timestamp timestamp")
    stored = cache.store_cache(made, "bucketed_cache_of_test", 4)
    asked = cache.with_query_hash(spark.createDataFrame([("q3",), ("q7",), ("none",), ("q3",)], "user_query string"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        found = cache.cache_lookup(asked, stored)
        text = plan(found)
        assert sorted(str((r["user_query"], r["cached_response"])) for r in found.collect()) == [
            "('none', None)", "('q3', 'a3')", "('q3', 'a3')", "('q7', 'a7')"]
        assert text.count("Exchange hashpartitioning") == 1 and "SelectedBucketsCount: 4 out of 4" in text
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
