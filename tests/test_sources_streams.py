import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from quern import fixed
from quern.operators import chunking, retrieval, upsert
from quern.session import new_folder, shared_folder
from quern.sources import files, tables
from quern.streaming import change_log, jobs


def test_file_scan(spark, tmp_path):
    for name in ("a.pdf", "B.PDF", "c.docx", "d.txt", "pdf"):
        (tmp_path / name).write_bytes(b"body of " + name.encode())
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "e.pdf").write_bytes(b"deep")
    got = files.file_scan(spark, str(tmp_path), fixed.DOCUMENT_EXTENSIONS)
    assert sorted(os.path.basename(r["path"]) for r in got.select("path").collect()) == ["B.PDF", "a.pdf", "c.docx"]
    assert files.file_scan(spark, str(tmp_path / "missing"), [".pdf"]).count() == 0


def test_files_to_chunks(spark, tmp_path):
    (tmp_path / "a.html").write_text("<p>Grüße</p><script>var x = '</p>';</script> <b>an  alle</b>", encoding="utf-8")
    found = files.raw_to_text(files.file_scan(spark, str(tmp_path), [".html"]), "content", "text")
    row = chunking.chunk_table(found, "path", "text").first()
    assert row["text_content"] == "Grüße an alle" and row["source"].endswith("a.html")


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "b"\nc, d'), (2, None)], "id int, t string")
    df.write.options(header=True, escape='"', quoteAll=True).csv(str(tmp_path / "c"))
    assert files.csv_scan(spark, str(tmp_path / "c"), "id int, t string").count() == 2


def test_tables(spark, tmp_path):
    tables.ensure_table(spark, "kept", fixed.CHUNK_SCHEMA)
    rows = tables.local_rows(spark, [("x_0", "s", "x", 0, None)], fixed.CHUNK_SCHEMA)
    tables.require_keys(rows, "chunk_id").write.mode("append").saveAsTable("kept")
    tables.ensure_table(spark, "kept", fixed.CHUNK_SCHEMA)
    assert tables.table_scan(spark, "kept", F.col("chunk_index") == 0, ["chunk_id"]).collect()[0]["chunk_id"] == "x_0"
    with pytest.raises(Exception, match="null in key column"):
        tables.require_keys(rows.withColumn("chunk_id", F.lit(None).cast("string")), "chunk_id").collect()
    tables.register_view(rows, "seen")
    assert spark.table("seen").count() == 1


def test_error_log_never_fails(spark):
    errors = tables.local_rows(spark, [(None, None, "boom")], "session_id string, user_query string, error_message string")
    assert tables.error_log_append(errors, "error_log")
    assert tables.error_log_append(errors.select("error_message", "user_query", "session_id"), "error_log", F.lit("2026-01-01").cast("timestamp"))
    got = spark.table("error_log")
    assert got.count() == 2 and got.where("error_message = 'boom' and session_id is null").count() == 2
    assert not tables.error_log_append(errors, "no_such_db.error_log")


def test_write_sized(spark, tmp_path):
    path = str(tmp_path / "out")
    tables.write_sized(spark.range(1000, numPartitions=50), path, max_records=400)
    parts = [f for f in os.listdir(path) if f.endswith(".parquet")]
    assert 3 <= len(parts) <= 8 and spark.read.parquet(path).count() == 1000


def test_spread_scan_leaves_fine_splits_alone(spark):
    many = spark.range(0, 100, 1, 32)
    assert tables.spread_scan(many, "id") is many
    assert tables.spread_scan(spark.range(0, 100, 1, 1), "id").rdd.getNumPartitions() == 8


def test_work_folder_comes_from_the_session(spark):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")
    assert new_folder(spark, "x").startswith(shared_folder(spark)) and new_folder(spark, "x") != new_folder(spark, "x")


# ---- streams -----------------------------------------------------------------

def drop(spark, src, rows):
    spark.createDataFrame(rows, jobs.DOCUMENT_SCHEMA).write.mode("append").parquet(src)


def as_dict(df):
    return {r["chunk_id"]: r["text_content"] for r in df.collect()}


def test_ingest_restart_and_index(spark):
    src, table, index = (new_folder(spark, n) for n in ("src", "chunks", "index"))
    ingest_at, sync_at = new_folder(spark, "cp"), new_folder(spark, "cp")

    def ingest():
        jobs.stream_ingest(spark, src, table, ingest_at, max_files=1).awaitTermination()

    def sync():
        jobs.stream_index_sync(spark, table, index, sync_at, max_files=1).awaitTermination()

    first = [("a", "x" * 2500, 0), ("b", "old text", 0), ("b", "newer text", 1)]
    drop(spark, src, first[:1])
    drop(spark, src, first[1:])
    ingest()
    ingest()  # a restart finds nothing to do
    wanted = spark.createDataFrame([("a", "x" * 2500), ("b", "newer text")], "path string, text string")
    assert as_dict(jobs.chunk_rows(spark, table)) == as_dict(chunking.chunk_table(wanted, "path", "text"))
    sync()

    drop(spark, src, [("b", "newest text", 2), ("c", "third", 0)])
    ingest()
    sync()
    batch = spark.createDataFrame([("b", "newest text"), ("c", "third")], "path string, text string")
    expected = upsert.upsert_chunks(chunking.chunk_table(wanted, "path", "text"), chunking.chunk_table(batch, "path", "text"))
    chunks = jobs.chunk_rows(spark, table)
    assert as_dict(chunks) == as_dict(expected)
    got = {r["chunk_id"]: tuple(r["tf"]) for r in jobs.synced_index(spark, index).collect()}
    fresh = {r["chunk_id"]: tuple(r["tf"]) for r in retrieval.embed_chunks(expected, "chunk_id", "text_content").collect()}
    assert got == fresh


def test_a_batch_that_runs_again_changes_nothing(spark):
    table = new_folder(spark, "log")
    schema = "chunk_id string, source string, doc_hash string, chunk_index int, text_content string, revision long"
    one = spark.createDataFrame([("k", "first source", "h", 0, "t1", 5)], schema)
    two = spark.createDataFrame([("k", "second source", "h2", 0, "t2", 5), ("n", "s", "h", 0, None, 0)], schema)
    assert jobs.chunk_rows(spark, table).count() == 0
    for _ in range(2):
        change_log.write_batch(one, table, 0)
        change_log.write_batch(two, table, 1)
        got = sorted(tuple(r) for r in jobs.chunk_rows(spark, table).collect())
        assert got == [("k", "first source", "h2", 0, "t2"), ("n", "s", "h", 0, None)]


def _log(spark, name="log"):
    table, ends = new_folder(spark, name), change_log.END
    schema = "chunk_id string, source string, doc_hash string, chunk_index int, text_content string, revision long, " + f"{ends} boolean"

    def doc(key, revision, *texts):
        rows = [(f"{key}_{i}", f"src{revision}", key, i, t, revision, False) for i, t in enumerate(texts)]
        return [*rows, (f"{key}_{len(texts)}", f"src{revision}", key, len(texts), None, revision, True)]

    def write(batch, *docs):
        change_log.write_batch(spark.createDataFrame([r for d in docs for r in d], schema), table, batch)

    return table, doc, write


def both(spark, table):
    return tuple(sorted(map(tuple, jobs.chunk_rows(spark, table, stale).collect())) for stale in (True, False))


def test_chunks_of_shortened_documents_are_told_in_any_order(spark):
    table, doc, write = _log(spark)
    write(0, doc("a", 2, "new a0"), doc("b", 0, "b0", "b1", "b2"), doc("c", 0, "c0"))
    write(1, doc("a", 1, "a0", "a1", "a2"), doc("b", 1, "B0", "B1"), doc("d", 0))
    write(2, doc("b", 2, "bb0", "bb1", "bb2", "bb3"), doc("c", 1))
    stale, live = both(spark, table)
    assert {r[0]: r[4] for r in live} == {"a_0": "new a0", "b_0": "bb0", "b_1": "bb1", "b_2": "bb2", "b_3": "bb3"}
    assert {r[0] for r in stale} - {r[0] for r in live} == {"a_1", "a_2", "c_0"}


def test_compaction_changes_no_row_and_bears_replays(spark):
    table, doc, write = _log(spark)
    write(0, doc("a", 0, "a0", "a1"), doc("b", 1, "b0"))
    write(1, doc("a", 1, "A0"), doc("b", 0, "old b0", "old b1"))
    before = both(spark, table)
    reader = jobs.chunk_rows(spark, table)
    assert jobs.compact_chunks(spark, table) == 1
    assert both(spark, table) == before
    write(1, doc("a", 1, "A0"), doc("b", 0, "old b0", "old b1"))  # runs again after the merge
    assert both(spark, table) == before
    write(2, doc("a", 2, "aa0", "aa1"), doc("c", 0, "c0"))
    later = both(spark, table)
    assert {r[0]: r[4] for r in later[1]} == {"a_0": "aa0", "a_1": "aa1", "b_0": "b0", "c_0": "c0"}
    write(3, doc("a", 1, "again, and longer", "x", "y"))  # an old revision, late
    expected = both(spark, table)
    assert jobs.compact_chunks(spark, table) == 3 and both(spark, table) == expected
    assert jobs.compact_chunks(spark, table) == 3  # nothing new
    assert sorted(map(tuple, reader.collect())) == before[0]
    change_log.clear(spark, table)
    assert both(spark, table) == expected
    assert not [n for n in os.listdir(table) if n.startswith("batch_id=")]


def test_compaction_stops_at_an_unfinished_batch_and_bears_a_stop(spark, monkeypatch):
    table, doc, write = _log(spark)
    for batch in range(3):
        write(batch, doc("a", batch, f"a{batch}"))
    os.remove(f"{table}/batch_id=1/_SUCCESS")
    expected = both(spark, table)
    assert jobs.compact_chunks(spark, table) == 0 and both(spark, table) == expected
    write(1, doc("a", 1, "a1"))
    assert {r[4] for r in both(spark, table)[0]} == {"a2"}

    def stop(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as patch:
        patch.setattr(files.Folder, "create", stop)
        with pytest.raises(KeyboardInterrupt):
            jobs.compact_chunks(spark, table)
    assert {r[4] for r in both(spark, table)[0]} == {"a2"}
    assert jobs.compact_chunks(spark, table) == 2


def test_a_stream_reads_past_a_base_and_the_index_forgets(spark):
    src, table, index = (new_folder(spark, n) for n in ("src", "chunks", "index"))
    ingest_at, sync_at = new_folder(spark, "cp"), new_folder(spark, "cp")
    live = {}
    for revision, text in enumerate(["x" * 2500, "short", "y" * 1500, None]):
        drop(spark, src, [("a", text, revision), (f"only{revision}", "other", 0)])
        jobs.stream_ingest(spark, src, table, ingest_at).awaitTermination()
        jobs.stream_index_sync(spark, table, index, sync_at).awaitTermination()
        live = {k: v for k, v in as_dict(jobs.chunk_rows(spark, table, stale=False)).items()}
        got = {r["chunk_id"]: tuple(r["tf"]) for r in jobs.synced_index(spark, index).collect()}
        fresh = retrieval.embed_chunks(jobs.chunk_rows(spark, table, stale=False), "chunk_id", "text_content")
        assert got == {r["chunk_id"]: tuple(r["tf"]) for r in fresh.collect()}
        if revision == 1:
            jobs.compact_chunks(spark, table)
            jobs.compact_index(spark, index)
    assert sorted(live.values()) == ["other"] * 4
    assert len(as_dict(jobs.chunk_rows(spark, table))) == 7


def test_resync_drops_keeps_and_renews(spark):
    def chunks(pairs):
        return spark.createDataFrame(pairs, "chunk_id string, text_content string")

    index = jobs.index_rows(chunks([("keep", "same"), ("change", "before"), ("gone", "x")]))
    marked = index.withColumn("embedding", F.transform("embedding", lambda x: x + 100))
    got = {r["chunk_id"]: r for r in jobs.index_resync(chunks([("keep", "same"), ("change", "after"), ("new", "y")]), marked).collect()}
    assert set(got) == {"keep", "change", "new"}
    assert max(got["keep"]["embedding"]) > 50 and max(got["change"]["embedding"]) <= 1


def test_error_stream_restart(spark):
    src, path, checkpoint = (new_folder(spark, n) for n in ("errors", "log", "cp"))
    schema = "timestamp timestamp, session_id string, user_query string, error_message string"
    spark.createDataFrame([(dt.datetime(2026, 1, 1), "s", "q", "e")], schema).write.parquet(src)
    for _ in range(2):
        jobs.stream_error_log(spark.readStream.schema(schema).parquet(src), path, checkpoint).awaitTermination()
    got = spark.read.parquet(path).collect()
    assert len(got) == 1 and got[0]["timestamp"] == dt.datetime(2026, 1, 1)


def test_csv_tells_empty_from_null(spark, tmp_path):
    rows = [(1, "", None), (2, None, "a\nb"), (3, 'say "x", y', "\\")]
    source = spark.createDataFrame(rows, "id int, a string, b string")
    path = str(tmp_path / "csv")
    source.write.options(header=True, escape='"', quoteAll=True, nullValue=files.CSV_NULL).csv(path)
    assert sorted(map(tuple, files.csv_scan(spark, path, source.schema).collect())) == rows
    (tmp_path / "plain.csv").write_text('id,a\n1,""\n2,\n')
    plain = files.csv_scan(spark, str(tmp_path / "plain.csv"), "id int, a string", multi_line=False)
    assert sorted(map(tuple, plain.collect())) == [(1, ""), (2, None)]
