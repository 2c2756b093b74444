import hashlib
import math
import random
import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quern.operators import chunking

LENGTHS = [0, 1, 499, 500, 999, 1000, 1001, 1899, 1900, 1901, 2800, 2801]


def fixed(text, size=1000, overlap=100):
    step = size - overlap
    n = max(math.ceil((len(text) - overlap) / step), 1)
    return [text[i * step:i * step + size] for i in range(n)]


def boundary(text, size=1000, overlap=100):
    """The cut rule, position by position."""
    out, pos = [], 0
    while True:
        if pos + size >= len(text):
            return out + [text[pos:]]
        window = text[pos:pos + size]
        cut = size
        for mark in ("\n", " "):
            at = window.rfind(mark) + 1
            if at >= size // 2:
                cut = at
                break
        out.append(window[:cut])
        pos += cut - overlap


def run(spark, texts, fn, **kw):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {}
    for r in fn(df, "id", "text", **kw).collect():
        got.setdefault(r["id"], {})[r["chunk_index"]] = r["text_content"]
    return [[got[i][j] for j in range(len(got[i]))] for i in range(len(texts))]


def texts():
    words = ("lorem ipsum dolor sit amet\n", "Straße über öl 🙂🙂 ")
    made = ["x" * n for n in LENGTHS] + ["🙂" * n for n in LENGTHS]
    for w in words:
        made += [(w * (n // len(w) + 1))[:n] for n in LENGTHS]
    made += ["y" * 400 + "\n" + "z" * 3000, "a b" * 1500, "\n" * 2500, " " * 1001]
    made += ["q" * 498 + " " + "r" * 700, "q" * 499 + " " + "r" * 700, "q" * 499 + "\n" + "r" * 700]
    return made


@pytest.mark.parametrize("fn,rule", [(chunking.chunk_fixed, fixed), (chunking.chunk_boundary, boundary)])
def test_edges(spark, fn, rule):
    made = texts()
    assert run(spark, made, fn) == [rule(t) for t in made]


@pytest.mark.parametrize("fn,rule", [(chunking.chunk_fixed, fixed), (chunking.chunk_boundary, boundary)])
def test_other_sizes(spark, fn, rule):
    made = texts()
    assert run(spark, made, fn, size=120, overlap=30) == [rule(t, 120, 30) for t in made]
    assert run(spark, made, fn, size=50, overlap=0) == [rule(t, 50, 0) for t in made]


@settings(max_examples=12, deadline=None)
@given(st.lists(st.text(alphabet="ab \nß🙂", max_size=400), min_size=1, max_size=20))
def test_any_text(spark, made):
    for fn, rule in ((chunking.chunk_fixed, fixed), (chunking.chunk_boundary, boundary)):
        got = run(spark, made, fn, size=40, overlap=10)
        assert got == [rule(t, 40, 10) for t in made]
        for text, chunks in zip(made, got):
            assert chunks[0] + "".join(c[10:] for c in chunks[1:]) == text
            assert max(map(len, chunks)) <= 40


def test_overlap_too_large():
    from pyspark.sql import functions as F

    with pytest.raises(ValueError):
        chunking.split_text(F.lit("x"), 100, 30)


def test_long_text_takes_linear_time(spark):
    """A text of eight million characters; a cut per chunk from the start would not end."""
    df = spark.range(1).selectExpr("1 as id", "repeat('word and more ', 600000) as text")
    row = chunking.chunk_stats(chunking.chunk_boundary(df, "id", "text")).first()
    assert row["longest"] <= 1000
    assert row["characters"] - (row["chunks"] - 1) * 100 == 600000 * 14


def test_chunk_table_ids(spark):
    df = spark.createDataFrame([("dir/ü.txt", "x" * 1500)], "path string, text string")
    rows = chunking.chunk_table(df, "path", "text").orderBy("chunk_index").collect()
    doc = hashlib.md5("dir/ü.txt".encode()).hexdigest()
    assert [r["chunk_id"] for r in rows] == [f"{doc}_0", f"{doc}_1"]
    assert {r["source"] for r in rows} == {"dir/ü.txt"}


@pytest.mark.parametrize("block", [1, 3, 4096])
def test_multipart_numbers_run_through_the_file(spark, block, monkeypatch):
    from quern.operators import spread

    monkeypatch.setattr(spread.running_offset, "__defaults__", (block, 2))
    parts = [("a", p, "x" * n) for p, n in enumerate([10, 2000, 0, 1000, 3000, 5])] + [("b", 7, "y" * 950)]
    df = spark.createDataFrame(parts, "file string, part int, text string")
    rows = chunking.chunk_multipart(df, "file", "part", "text").orderBy("file", "chunk_index").collect()
    expected = [(f, p, c) for f, p, t in parts for c in fixed(t)]
    assert [(r["file"], r["part"], r["text_content"]) for r in rows] == expected
    a = [r["chunk_index"] for r in rows if r["file"] == "a"]
    assert a == list(range(len(a)))


def test_chunking_neither_shuffles_nor_leaves_the_jvm(spark, small_dir, plan):
    df = spark.read.parquet(f"{small_dir}/documents.parquet")
    for boundary_rule in (False, True):
        text = plan(chunking.chunk_table(df, "source", "text", boundary=boundary_rule))
        assert "Exchange" not in text and "Python" not in text and "InArrow" not in text
        assert "ReadSchema: struct<text:string,source:string>" in text


def pieces(text, size):
    out = []
    for paragraph in re.findall(r"(?s).+?(?:\n{2,}|\Z)", text):
        for line in [paragraph] if len(paragraph) <= size else re.findall(r"[^\n]*\n+|[^\n]+", paragraph):
            for word in [line] if len(line) <= size else re.findall(r"[^ ]* +|[^ ]+", line):
                out += [word[i:i + size] for i in range(0, len(word), size)]
    return out


def packed(text, size, overlap):
    """Straight from the rule: for each chunk the longest run of pieces, then the tail."""
    parts, out, first = pieces(text, size), [], 0
    while True:
        end = first
        while end < len(parts) and sum(map(len, parts[first:end + 1])) <= size:
            end += 1
        out.append("".join(parts[first:end]))
        if end == len(parts):
            return out
        while (tail := sum(map(len, parts[first:end]))) > overlap or tail + len(parts[end]) > size:
            first += 1


def test_chunks_of_whole_pieces(spark):
    rnd = random.Random(2)
    made = ["".join(rnd.choices(["word", "é漢", " ", "  ", "\n", "\n\n", "\n\n\n", "x" * 25, ". "], k=rnd.randrange(0, 90))) for _ in range(150)]
    made += ["", " ", "\n", "\n\n", "a" * 100, "one two\n\nthree", "p " * 40 + "\n\n" + "q " * 3]
    for size, overlap in ((20, 5), (40, 0), (60, 20)):
        got = run(spark, made, chunking.chunk_pieces, size=size, overlap=overlap)
        for text, chunks in zip(made, got):
            assert chunks == packed(text, size, overlap), (text, size, overlap)
            assert all(len(c) <= size for c in chunks)


def test_pieces_of_a_long_text_take_linear_time(spark):
    def seconds(n):
        df = spark.createDataFrame([(1, "some words here. " * 60 + "\n")], "id int, line string").select(
            "id", F.repeat("line", n).alias("text"))
        start = time.perf_counter()
        assert chunking.chunk_pieces(df, "id", "text").count() > n
        return time.perf_counter() - start

    seconds(20)
    short, long = min(seconds(200) for _ in range(2)), seconds(2000)
    assert long < 10 * short + 8


def test_null_text_has_no_chunks_and_keys_go_along(spark):
    df = spark.createDataFrame([("a", None), ("b", ""), ("c", "one\n\ntwo")], "path string, text string")
    rows = chunking.chunk_table(df, "path", "text", pieces=True).collect()
    assert {(r["source"], r["chunk_index"], r["text_content"]) for r in rows} == {("b", 0, ""), ("c", 0, "one\n\ntwo")}
