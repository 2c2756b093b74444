"""SimHash near-duplicates through segment popcounts.

A fingerprint of 64 bits is cut into 16 segments of four; the set bits per segment
make a point with 16 coordinates from 0 to 4. The Manhattan distance of two points
is at most the Hamming distance of their fingerprints, so fingerprints at two bits
or fewer have points at distance two or less. Such points have a grid cell in common
among those at distance one or less from either: each fingerprint is posted to its
own cell and the valid ones beside it (33 at most), and what meets in a cell is
compared exactly. No fingerprint is ever compared outside its cells.

A cell with more than `CROWDED` fingerprints is not paired up. Its fingerprints are
posted to the 65 bit strings at one bit or fewer; fingerprints at two bits or fewer
share one, and whatever shares one is at two bits or fewer, so it is enough to link
each to the smallest there. Links then grow with the fingerprints, not their square.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from quern.llm.common import Saved, body, prepared, table
from quern.llm.components import components

SEGMENTS = 16
#: Fingerprints in a cell up to which they are compared one by one.
CROWDED = 24
MAX_BITS = 2
#: Words of the shingles that make a fingerprint.
FINGERPRINT_WORDS = 3
SEED = 42
_SLICE = 1 << 16
#: MinHash bands of the near-duplicate stage, their rows, shingles hashed at once there.
BANDS, BAND_ROWS = 16, 4
#: Members of a crowded bucket, and shingles of these, that make a block of it.
BLOCK_MEMBERS, BLOCK_SHINGLES = 1024, 1 << 21
_SKETCH_SLICE = 1 << 12


def simhash(data: bytes, words: int) -> int:
    """The signed 64-bit fingerprint of a text's UTF-8 bytes.

    `bytes.lower` and `bytes.split` are the A-Z and white-space rules asked for.
    """
    tokens = data.lower().split()
    if not tokens:
        return 0
    if len(tokens) < words:
        shingles: Iterator[bytes] = iter([b" ".join(tokens)])
    else:
        shingles = map(b" ".join, zip(*(tokens[i:] for i in range(words))))
    total = max(1, len(tokens) - words + 1)
    counts = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for start in range(0, total, _SLICE):
        size = min(_SLICE, total - start)
        hashes = np.fromiter((digest(next(shingles), SEED) for _ in range(size)), np.uint64, size)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > total, bitorder="little").view(np.int64)[0])


def fingerprint(text: Column, words: int = FINGERPRINT_WORDS) -> Column:
    """Fingerprints of `words`-word shingles; null and blank texts have zero."""

    @F.pandas_udf(T.LongType())
    def of(bodies: pd.Series) -> pd.Series:
        return pd.Series([simhash(b, words) for b in bodies], dtype="int64")

    return of(body(text))


def _nibbles(half: Column) -> Column:
    """Set bits per four of a 32-bit number, each sum in its own four bits."""
    pairs = half.bitwiseAND(0x55555555) + F.shiftright(half, 1).bitwiseAND(0x55555555)
    return pairs.bitwiseAND(0x33333333) + F.shiftright(pairs, 2).bitwiseAND(0x33333333)


def point(fp: Column) -> Column:
    """The 16 segment counts, four bits each. In halves, as the sums would overflow."""
    low = _nibbles(fp.bitwiseAND(0xFFFFFFFF))
    high = _nibbles(F.shiftrightunsigned(fp, 32))
    return F.shiftleft(high, 32).bitwiseOR(low)


def _cells(at: Column) -> Column:
    cells = [at]
    for i in range(SEGMENTS):
        count = F.shiftright(at, 4 * i).bitwiseAND(7)
        step = F.lit(1 << (4 * i)).cast("long")
        cells += [F.when(count < 4, at + step), F.when(count > 0, at - step)]
    return F.array_compact(F.array(*cells))


def links(fps: DataFrame, crowded: int = CROWDED) -> DataFrame:
    """Distinct fingerprints `fp` to links (a, b) at two bits or fewer, a < b.

    Within crowded cells the links connect whatever is connected, without listing
    every pair; all others are listed. Every link is a true one.
    """
    fp, b = F.col("fp"), F.col("b")
    posts = fps.select("fp", point(fp).alias("at")).select("fp", F.explode(_cells(F.col("at"))).alias("cell"))
    shared = posts.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = posts.join(shared, "cell")

    def near(x: Column, y: Column) -> Column:
        return F.bit_count(x.bitwiseXOR(y)) <= MAX_BITS

    few = met.where(F.col("n") <= crowded).groupBy("cell").agg(F.collect_list("fp").alias("fps"))
    paired = few.select(F.explode(F.flatten(F.transform("fps", lambda x: F.transform(
        F.filter("fps", lambda y: (x < y) & near(x, y)), lambda y: F.struct(x.alias("a"), y.alias("b"))
    )))).alias("pair")).select("pair.a", "pair.b")

    many = met.where(F.col("n") > crowded).select("fp").distinct()
    flips = F.array(F.lit(0).cast("long"), *(F.lit(1 << i if i < 63 else -(1 << 63)).cast("long") for i in range(64)))
    flipped = many.select("fp", F.explode(F.transform(flips, lambda m: fp.bitwiseXOR(m))).alias("near"))
    least = flipped.groupBy("near").agg(F.min("fp").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1")
    starred = flipped.join(least, "near").select("a", fp.alias("b")).where(F.col("a") < b)
    return paired.unionByName(starred).distinct()


def grouped(fingerprints: DataFrame, crowded: int = CROWDED) -> DataFrame:
    """(doc_id, fingerprint long) with `component_id`, the smallest doc_id reachable.

    Rows with a null doc_id take part like any other; a component of nothing else has
    a null component_id. Repeated rows stay repeated. No rows give no rows.
    `fingerprints` is read several times: hand in a saved table.
    """
    fps = fingerprints.groupBy(F.col("fingerprint").alias("fp")).agg(F.min("doc_id").alias("least"))
    roots = components(links(fps.select("fp"), crowded))
    rooted = fps.join(roots, fps.fp == roots.node, "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(ids, "root").select("fp", "component_id")
    return fingerprints.join(named, fingerprints.fingerprint == named.fp).select(
        "doc_id", "fingerprint", "component_id")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = FINGERPRINT_WORDS
) -> DataFrame:
    """One row (doc_id, fingerprint long, component_id) per document.

    Null or blank texts have fingerprint zero and are linked like any other. Other
    columns of `docs` are not looked at, whatever their names.
    """
    prepared(docs.sparkSession)
    marked = docs.select(F.col(id_col).alias("doc_id"), fingerprint(F.col(text_col), words).alias("fingerprint"))
    return grouped(Saved(marked, "fingerprints").df)


def _shingles(data: bytes, words: int) -> set[tuple[bytes, ...]]:
    tokens = data.lower().split()
    if len(tokens) < words:
        return {tuple(tokens)} if tokens else set()
    return set(zip(*(tokens[i:] for i in range(words))))


def jaccard(a: bytes, b: bytes, words: int) -> float:
    """Of the two texts' shingle sets; two texts without words are alike."""
    one, other = _shingles(a, words), _shingles(b, words)
    both = len(one & other)
    return both / (len(one) + len(other) - both) if one or other else 1.0


_random = np.random.default_rng(SEED)
_FACTOR = _random.integers(0, 1 << 63, BANDS * BAND_ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFT = _random.integers(0, 1 << 63, BANDS * BAND_ROWS, dtype=np.uint64)


def _hashes(data: bytes, words: int) -> np.ndarray:
    """Of a text's shingles, rising, each once."""
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(b" ".join(s), SEED) for s in _shingles(data, words)), np.uint64))


def sketch(data: bytes, words: int) -> tuple[int, list[int]]:
    """Of the set of a text's shingles: a digest and the MinHash bands.

    Repeats count once here, as they do in a Jaccard similarity.
    """
    digest = xxhash.xxh64_intdigest
    hashes = _hashes(data, words)
    least = np.full(len(_FACTOR), (1 << 32) - 1, np.uint64)
    for start in range(0, len(hashes), _SKETCH_SLICE):
        part = hashes[start:start + _SKETCH_SLICE]
        least = np.minimum(least, ((part * _FACTOR[:, None] + _SHIFT[:, None]) >> np.uint64(32)).min(axis=1))
    bands = [digest(bytes([i]) + row.tobytes(), SEED) for i, row in enumerate(least.reshape(BANDS, BAND_ROWS))]
    shape, *bands = np.array([digest(hashes.tobytes(), SEED), *bands], np.uint64).view(np.int64).tolist()
    return shape, bands


def _sketched(text: Column, words: int) -> Column:
    """The fingerprint of `near_duplicates` and the sketch, from one reading of a text."""
    kind = pa.struct([("shape", pa.int64()), ("fp", pa.int64()), ("bands", pa.list_(pa.int64()))])

    @F.arrow_udf("struct<shape: long, fp: long, bands: array<long>>")
    def of(bodies: pa.Array) -> pa.Array:
        def marks(data: bytes) -> dict:
            shape, bands = sketch(data, words)
            return {"shape": shape, "fp": simhash(data, FINGERPRINT_WORDS), "bands": bands}

        return pa.array([marks(b.as_py()) for b in bodies], kind)

    return of(body(text))


def _band_pairs(shapes: DataFrame, crowded: int) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) of shapes that share a band's bucket of up to `crowded` members, and
    the distinct shapes in larger ones."""
    posts = shapes.select("shape", F.explode("bands").alias("band"))
    shared = posts.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = posts.join(shared, "band")
    few = met.where(F.col("n") <= crowded).groupBy("band").agg(F.collect_list("shape").alias("all"))
    paired = few.select(F.explode(F.flatten(F.transform("all", lambda x: F.transform(
        F.filter("all", lambda y: x < y), lambda y: F.struct(x.alias("a"), y.alias("b"))
    )))).alias("pair")).select("pair.a", "pair.b")
    return paired, met.where(F.col("n") > crowded).select("shape").distinct()


def _parities(sets: list[np.ndarray]) -> np.ndarray:
    """Bits that tell, per remainder, whether an odd number of a set's hashes has it. Two
    sets differ in as many hashes as their bits do, or more."""
    mean = sum(map(len, sets)) // max(1, len(sets))
    bits = 1 << min(16, max(9, (8 * mean).bit_length()))
    out = np.zeros((len(sets), bits // 64), np.uint64)
    for i, hashes in enumerate(sets):
        odd = np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
        out[i] = np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)
    return out


def linked(
    sets: list[np.ndarray], bands: np.ndarray, at: int, side: np.ndarray | None, similarity: float
) -> list[tuple[int, int]]:
    """Links (i, j) of sets of hashes with a Jaccard similarity of `similarity` or more:
    they connect whatever such pairs connect, so each is one link fewer to look for.

    All pairs count, with `side` only those of unlike sides. Pairs that share a band
    before band `at` are left to the bucket of that one. Pairs are passed over only where
    sizes or parities rule them out; the others are compared whole.
    """
    size, parity = np.array([len(s) for s in sets]), _parities(sets)
    label = np.arange(len(sets))
    most = (1 - similarity) / (1 + similarity)
    found = []
    for i in range(len(sets) - 1):
        rest = slice(i + 1, len(sets))
        fits = (label[rest] != label[i]) & (abs(size[rest] - size[i]) <= (size[rest] + size[i]) * most + 1e-6)
        if side is not None:
            fits &= side[rest] != side[i]
        j = np.flatnonzero(fits) + i + 1
        j = j[~(bands[j, :at] == bands[i, :at]).any(axis=1)]
        differ = np.bitwise_count(parity[j] ^ parity[i]).sum(axis=1, dtype=np.int64)
        for k in j[differ <= (size[j] + size[i]) * most + 1e-6].tolist():
            if label[k] != label[i]:
                both = len(np.intersect1d(sets[i], sets[k], assume_unique=True))
                if both >= (similarity - 1e-9) * (size[i] + size[k] - both):
                    found.append((i, k))
                    label[label == label[k]] = label[i]
    return found


def _crowd_links(crowds: DataFrame, similarity: float, crowded: int) -> DataFrame:
    """Links (a, b) within the buckets of more than `crowded` members, every pair looked
    at. `crowds` (shape, bands, hashes) has all members of these.

    A bucket is cut into blocks of bounded size and these are compared two by two, so no
    task holds more than two. What a task returns grows with its members, not their square.
    """
    posts = crowds.select("shape", (F.length("hashes") / 8).alias("size"), F.posexplode("bands").alias("at", "band"))
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK_MEMBERS), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    buckets = posts.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("shingles")).where(
        F.col("n") > crowded).select("band", blocks.alias("blocks"))
    own = F.pmod(F.xxhash64("shape", "band"), F.col("blocks")).cast("int")
    cells = posts.join(buckets, "band").select("shape", "at", "band", "blocks", own.alias("own")).select(
        "shape", "at", "band", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).select(
        "shape", "at", "band", "own", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))

    def links_of(cell: pd.DataFrame) -> pd.DataFrame:
        shape, side = cell["shape"].to_numpy(np.int64), cell["own"].to_numpy()
        sets = [np.frombuffer(h, np.uint64) for h in cell["hashes"]]
        across = cell["lo"].iloc[0] != cell["hi"].iloc[0]
        found = linked(sets, np.stack(cell["bands"].to_list()), int(cell["at"].iloc[0]), side if across else None, similarity)
        one, other = np.array(found, np.int64).reshape(-1, 2).T
        return pd.DataFrame({"a": shape[one], "b": shape[other]})

    return cells.join(crowds, "shape").groupBy("band", "lo", "hi").applyInPandas(links_of, "a long, b long")


def _fingerprint_links(marks: DataFrame, crowded: int) -> DataFrame:
    """Links (a, b) of shapes that connect those with fingerprints at two bits or fewer:
    each shape with the smallest of its fingerprint, and those of linked fingerprints.
    `marks` has every (shape, fp) that occurs."""
    least = marks.groupBy("fp").agg(F.min("shape").alias("least"))
    same = marks.join(least, "fp").where("shape != least").select(F.col("least").alias("a"), F.col("shape").alias("b"))
    one, other = (least.select(F.col("fp").alias(n), F.col("least").alias(f"{n}_shape")) for n in "ab")
    near = links(least.select("fp"), crowded).join(one, "a").join(other, "b")
    return same.unionByName(near.select(F.least("a_shape", "b_shape").alias("a"), F.greatest("a_shape", "b_shape").alias("b")))


def similar(
    rows: DataFrame, shapes: DataFrame, text_col: str, words: int, similarity: float, crowded: int = CROWDED
) -> DataFrame:
    """Links (a, b) of shapes whose texts' shingle sets have a Jaccard similarity of
    `similarity` or more, compared whole. `shapes` names a row of `rows` for each. Crowds
    are connected without listing every pair."""
    few, many = _band_pairs(shapes, crowded)
    pairs = Saved(few.distinct(), "pairs").df
    many = Saved(many, "crowded").df
    met = pairs.select(F.explode(F.array("a", "b")).alias("shape")).unionByName(many).distinct()
    wanted = shapes.join(met, "shape").select("shape", "_quern_row")
    text = body(F.col(text_col)).alias("text")
    texts = Saved(rows.select("_quern_row", text).join(wanted, "_quern_row").select("shape", "text"), "texts", "zstd").df

    @F.pandas_udf(T.BooleanType())
    def alike(one: pd.Series, other: pd.Series) -> pd.Series:
        return pd.Series([jaccard(a, b, words) >= similarity - 1e-9 for a, b in zip(one, other)], dtype=bool)

    @F.pandas_udf(T.BinaryType())
    def hashes(bodies: pd.Series) -> pd.Series:
        return pd.Series([_hashes(b, words).tobytes() for b in bodies], dtype=object)

    one, other = (texts.select(F.col("shape").alias(n), F.col("text").alias(f"{n}_text")) for n in "ab")
    near = pairs.join(one, "a").join(other, "b").where(alike("a_text", "b_text")).select("a", "b")
    inside = shapes.join(many, "shape", "left_semi").select("shape", "bands").join(texts, "shape")
    crowds = Saved(inside.select("shape", "bands", hashes("text").alias("hashes")), "crowds").df
    return near.unionByName(_crowd_links(crowds, similarity, crowded))


def without_near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8
) -> DataFrame:
    """`docs` with one row of each group of near-duplicates: that with the smallest id,
    of equal ids that with the smallest text hash. Rows without an id come last.

    Rows are linked as `near_duplicates` links them, by fingerprints at two bits or fewer,
    and a group is what links connect. Beside that, rows are linked if their sets of
    `words`-word shingles have a Jaccard similarity of `similarity` or more, as most such
    pairs are further apart than two bits. MinHash bands propose these: a pair at 0.8 stays
    unseen with a chance of 2 in 10,000. What they propose is compared exactly, and buckets
    of any size are compared in full.

    Null, empty and blank texts are alike. Columns of any name pass through.
    """
    prepared(docs.sparkSession)
    row, made = "_quern_row", "_quern_sketch"
    rows = Saved(docs.withColumn(row, F.monotonically_increasing_id())
                 .withColumn(made, _sketched(F.col(text_col), words)), "rows", "zstd").df

    def firsts(df: DataFrame, key: str) -> DataFrame:
        order = Window.partitionBy(key).orderBy(F.col("id").asc_nulls_last(), "hash", row)
        return df.withColumn("rank", F.row_number().over(order)).where("rank = 1").drop("rank")

    narrow = rows.select(row, F.col(id_col).alias("id"), F.xxhash64(text_col).alias("hash"), f"{made}.*")
    shapes = Saved(firsts(narrow, "shape"), "shapes").df
    marks = Saved(narrow.select("shape", "fp").distinct(), "marks").df
    found = _fingerprint_links(marks, CROWDED).unionByName(similar(rows, shapes, text_col, words, similarity))
    roots = components(found)
    rooted = shapes.join(roots, shapes.shape == roots.node, "left").select(
        row, "id", "hash", F.coalesce("root", "shape").alias("root"))
    return rows.join(firsts(rooted, "root").select(row), row, "left_semi").select(*docs.columns)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint as 16 hexadecimal digits, and its component."""
    found = near_duplicates(table(prepared(spark), sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")
