"""A sample of documents whose features are spread as those of a target are.

A document's features are its words and pairs of words, hashed to buckets by CRC-32. The
checksum of a pair follows from those of its words, as CRC-32 is linear, so a batch of
texts is hashed as arrays: the words byte position by byte position, the pairs by
advancing the first word's checksum over the length of the second. Each bucket has a
gain, and the weight of a document is its features' mean gain, summed as arrays.

A random term is added to the weight and the highest scores are drawn. The lowest key
that is still drawn is found by weighted median of medians: every task reports the
median of its remaining keys and how many there are; the median of these, weighted by
their numbers, has at least a quarter of all remaining keys on either side, so each
round discards a quarter or more for certain, whatever the keys. Only the keys that are
drawn are sorted.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import Saved, body, prepared, table

BUCKETS = 10_000
LEAST_WORDS = 20
PERCENT = 25
SEED = 7
#: Bytes of text hashed at once; longer texts are hashed in slices.
SLICE = 1 << 21
#: Remaining keys are written anew when they have become fewer than this share.
REWRITE = 0.25

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IN_WORD = np.zeros(256, bool)
_IN_WORD[48:58] = _IN_WORD[97:123] = _IN_WORD[128:] = True
_ONES = np.uint32(0xFFFFFFFF)


def _byte_table() -> np.ndarray:
    """What each byte does to a checksum, from checksums of single bytes."""
    at_zero = zlib.crc32(b"\0")
    return np.array([zlib.crc32(bytes([b])) ^ at_zero for b in range(256)], np.uint32)


_BYTE = _byte_table()


def _zero_byte(state: np.ndarray) -> np.ndarray:
    return _BYTE[state & np.uint32(255)] ^ (state >> np.uint32(8))


def _power_tables(powers: int) -> list[np.ndarray]:
    """For 1, 2, 4, … zero bytes: what they make of a state, per byte of the state."""
    each = np.arange(256, dtype=np.uint32)
    tables = [np.stack([_zero_byte(each << np.uint32(8 * i)) for i in range(4)])]
    for _ in range(powers - 1):
        tables.append(np.stack([_advanced(row, tables[-1]) for row in tables[-1]]))
    return tables


def _advanced(state: np.ndarray, by: np.ndarray) -> np.ndarray:
    out = by[0][state & np.uint32(255)]
    for i in range(1, 4):
        out = out ^ by[i][state >> np.uint32(8 * i) & np.uint32(255)]
    return out


_POWERS = _power_tables(32)
_BLANK = np.uint32(zlib.crc32(b" "))
#: Bytes of a word up to which its checksum is made beside others'.
_SHORT = 48


def after_zeros(state: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The states after `n` zero bytes each: one table for each bit of `n`."""
    state = state.copy()
    for bit in range(int(n.max()).bit_length() if len(n) else 0):
        at = np.flatnonzero(n >> bit & 1)
        state[at] = _advanced(state[at], _POWERS[bit])
    return state


def word_checksums(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-32 of each span of bytes: those of up to `_SHORT` bytes all together, one byte
    further at a time, longer ones each by itself."""
    length = end - start
    order = np.argsort(-length, kind="stable")
    first, falling = start[order], -length[order]
    skip = int(np.searchsorted(falling, -_SHORT))
    out = np.full(len(start), _ONES, np.uint32)
    for k in range(-int(falling[skip]) if skip < len(falling) else 0):
        at = slice(skip, int(np.searchsorted(falling, -k)))  # these are longer than k
        out[at] = _BYTE[(out[at] ^ data[first[at] + k]) & np.uint32(255)] ^ (out[at] >> np.uint32(8))
    out ^= _ONES
    for i in range(skip):
        out[i] = zlib.crc32(data[first[i]:first[i] - falling[i]])
    state = np.empty_like(out)
    state[order] = out
    return state


def joined(first: np.ndarray, second: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Checksums of two words with a blank between, from theirs; `length` is the second's."""
    return after_zeros(_advanced(first, _POWERS[0]) ^ _BLANK, length) ^ second


def _slices(data: np.ndarray) -> Iterator[tuple[int, int]]:
    """Parts of about `SLICE` bytes, cut between words only."""
    at = 0
    while at < len(data):
        end = min(at + SLICE, len(data))
        while end < len(data) and _IN_WORD[data[end]]:
            end += 1
        yield at, end
        at = end


def features(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Checksums of the words of texts and which text each is of, and the same of pairs of
    neighbouring words, slice by slice of the texts laid end to end."""
    data = _LOWER[np.frombuffer(b"\0".join(texts), np.uint8)]
    begins = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])[:-1]])
    last, of_last = np.zeros(0, np.uint32), np.zeros(0, np.int64)  # the last word so far
    for at, end in _slices(data):
        edges = np.flatnonzero(np.diff(_IN_WORD[data[at:end]].view(np.int8), prepend=0, append=0)) + at
        start, stop = edges[::2], edges[1::2]
        one, text = word_checksums(data, start, stop), np.searchsorted(begins, start, "right") - 1
        before, of_before = np.concatenate([last, one])[:len(one)], np.concatenate([of_last, text])[:len(one)]
        new = 1 - len(last)  # the first word of all has none before it
        after, of_after, length = one[new:], text[new:], (stop - start)[new:]
        before, of_before = before[:len(after)], of_before[:len(after)]
        same = np.flatnonzero(of_before == of_after)
        yield one, text, joined(before[same], after[same], length[same]), of_after[same]
        if len(one):
            last, of_last = one[-1:], text[-1:]


def _grouped(bodies: list[bytes]) -> Iterator[slice]:
    """Runs of texts of about `SLICE` bytes in all."""
    at, held = 0, 0
    for i, text in enumerate(bodies):
        held += len(text)
        if held >= SLICE:
            yield slice(at, i + 1)
            at, held = i + 1, 0
    if at < len(bodies):
        yield slice(at, len(bodies))


def bucket_counts(docs: DataFrame, text_col: str, buckets: int) -> np.ndarray:
    """How many features of all texts fall into each bucket; one row a task and bucket."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(buckets, np.int64)
        for batch in batches:
            bodies = batch.column(0).to_pylist()
            for part in _grouped(bodies):
                for one, _, two, _ in features(bodies[part]):
                    for hashes in (one, two):
                        counts += np.bincount(hashes % np.uint32(buckets), minlength=buckets)
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(counts[seen], pa.int64())], names=["bucket", "n"])

    found = docs.select(body(F.col(text_col)).alias("text")).mapInArrow(run, "bucket int, n long")
    out = np.zeros(buckets, np.int64)
    for row in found.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # `buckets` rows at most
        out[row.bucket] = row.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """What a feature of each bucket is worth, in thousandths."""
    n, s, t = float(len(source)), float(source.sum()), float(target.sum())
    ratio = (target + 1.0) * (s + n) / ((source + 1.0) * (t + n))
    return np.array([math.floor(1000 * math.log(r)) for r in ratio.tolist()], np.int64)


def weights(text: Column, gain: np.ndarray) -> Column:
    """Of a text: its words, its features, and their mean gain, floored."""
    kind = pa.struct([("words", pa.int64()), ("n", pa.int64()), ("weight", pa.int64())])
    buckets = np.uint32(len(gain))

    @F.arrow_udf("struct<words: long, n: long, weight: long>")
    def of(bodies: pa.Array) -> pa.Array:
        bodies, out = bodies.to_pylist(), []
        for part in _grouped(bodies):
            rows = bodies[part]
            words, n, total = (np.zeros(len(rows), np.int64) for _ in range(3))
            for one, of_one, two, of_two in features(rows):
                words += np.bincount(of_one, minlength=len(rows))
                for hashes, texts in ((one, of_one), (two, of_two)):
                    n += np.bincount(texts, minlength=len(rows))
                    total += np.bincount(texts, gain[hashes % buckets], len(rows)).astype(np.int64)
            out += zip(words.tolist(), n.tolist(), (total // np.maximum(n, 1)).tolist())
        return pa.array([dict(zip(("words", "n", "weight"), row)) for row in out], kind)

    return of(body(text))


Key = tuple[int, ...]
_KEY = ("low", "id", "row")


def _kth(columns: list[np.ndarray], k: int) -> Key:
    """The key at place k of their order, without sorting them."""
    out = []
    for i, column in enumerate(columns):
        value = np.partition(column, k)[k]
        k -= int((column < value).sum())
        same = column == value
        columns[i + 1:] = [c[same] for c in columns[i + 1:]]
        out.append(int(value))
    return tuple(out)


def _upto(columns: list[np.ndarray], pivot: Key) -> np.ndarray:
    """Which keys are at the pivot or before it."""
    out = np.ones(len(columns[0]), bool)
    for column, value in zip(reversed(columns), reversed(pivot)):
        out = (column < value) | ((column == value) & out)
    return out


def _reports(keys: DataFrame, pivot: Key | None) -> list[tuple[bool, int, Key]]:
    """Of each task's keys, those up to the pivot and those beyond: how many, and their
    median. Two rows a task come to the driver."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = [[c.to_numpy() for c in batch.columns] for batch in batches]
        if not read:
            return
        columns = [np.concatenate(c) for c in zip(*read)]
        upto = np.ones(len(columns[0]), bool) if pivot is None else _upto(columns, pivot)
        for side in (True, False):
            part = [c[upto == side] for c in columns]
            if n := len(part[0]):
                row = [side, n, *_kth(part, (n - 1) // 2)]
                yield pa.RecordBatch.from_arrays([pa.array([x]) for x in row], names=["upto", "n", *_KEY])

    found = keys.mapInArrow(run, "upto boolean, n long, low long, id long, row long").collect()
    return [(r.upto, r.n, tuple(r[2:])) for r in found]


def weighted_median(found: list[tuple[int, Key]]) -> Key:
    half, seen = sum(n for n, _ in found) / 2, 0
    for n, key in sorted(found, key=lambda x: x[1]):
        seen += n
        if seen >= half:
            return key
    raise ValueError("no keys")


def cutoff(keys: DataFrame, need: int) -> Key | None:
    """The `need`-th of the keys, rising; None if there are none to take. `keys` (low, id,
    row), all long, no two alike."""
    if need <= 0:
        return None
    at = F.struct(*_KEY)
    literal = lambda key: F.struct(*(F.lit(v).cast("long") for v in key))
    written, rest = None, keys
    sides = _reports(keys, None)
    remaining = size = sum(n for _, n, _ in sides)
    if need >= remaining:
        return tuple(rest.agg(F.max(at).alias("k")).first().k) if remaining else None
    upto = True
    while True:
        pivot = weighted_median([(n, key) for side, n, key in sides if side == upto])
        sides = _reports(rest, pivot)
        below = sum(n for side, n, _ in sides if side)
        if below == need:
            break
        upto = below > need
        rest = rest.where(at <= literal(pivot)) if upto else rest.where(at > literal(pivot))
        remaining, need = (below, need) if upto else (remaining - below, need - below)
        if remaining < REWRITE * size:
            narrowed = Saved(rest, "keys")
            if written:
                written.drop()
            written, rest, size = narrowed, narrowed.df, remaining
    if written:
        written.drop()
    return pivot


def ranked(keys: DataFrame, last: Key | None) -> DataFrame:
    """(row, rank) of the keys up to `last`, in their order. Only these are sorted; a task
    numbers its own, and how many each has gives where it begins."""
    spark = keys.sparkSession
    if last is None:
        return spark.createDataFrame([], "row long, rank long")
    drawn = keys.where(F.struct(*_KEY) <= F.struct(*(F.lit(v).cast("long") for v in last)))
    placed = Saved(drawn.orderBy(*_KEY).select("row", F.monotonically_increasing_id().alias("place")), "drawn").df
    task = F.shiftright("place", 33)
    begins, total = [], 0
    for row in sorted(placed.groupBy(task.alias("task")).agg(F.count(F.lit(1)).alias("n")).collect()):  # a row a task
        begins.append((row.task, total))
        total += row.n
    begins = spark.createDataFrame(begins, "task long, begin long")
    own = F.col("place").bitwiseAND((1 << 33) - 1)
    return placed.join(F.broadcast(begins), task == begins.task).select("row", (F.col("begin") + own + 1).alias("rank"))


def resampled(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text",
    buckets: int = BUCKETS, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED,
) -> DataFrame:
    """(doc_id, n_features, weight, score, rank), one row per document; `rank` numbers the
    drawn from 1, the others have none.

    Of the documents of `least_words` words or more, `percent` in a hundred are drawn,
    rounded down. The random term depends on the seed and the id alone. Null and wordless
    texts have no features and weight 0. Ties go to the smaller id; a null id is read as
    an empty text in the random term and comes after all others. Rows that repeat take
    part each time, in any order among themselves. No documents give no rows; an empty
    target has no features. Other columns are not looked at.
    """
    prepared(docs.sparkSession)
    gain = gains(bucket_counts(docs, text_col, buckets), bucket_counts(target, target_col, buckets))
    given = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), weights(F.col(text_col), gain).alias("of"),
        F.monotonically_increasing_id().alias("row"))
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")
    scored = Saved(given.select(
        "row", "doc_id", F.col("of.words").alias("words"), F.col("of.n").alias("n_features"),
        F.col("of.weight").alias("weight"), (F.col("of.weight") + noise).alias("score")), "scored").df
    last_id = F.lit((1 << 63) - 1).cast("long")
    keys = Saved(scored.where(F.col("words") >= least_words).select(
        (-F.col("score")).alias("low"), F.coalesce("doc_id", last_id).alias("id"), "row"), "keys").df
    ranks = ranked(keys, cutoff(keys, keys.count() * percent // 100))
    return scored.join(ranks, "row", "left").select("doc_id", "n_features", "weight", "score", "rank")


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter of the documents, drawn towards the texts of the benchmark."""
    return resampled(table(prepared(spark), sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
