"""Documents as token ids, packed into windows by best-fit decreasing.

Which window a piece goes to depends on the lengths only, and a piece is at most as
long as a window. So the plan is drawn up from the number of pieces of each length
(at most `window` numbers, however many documents there are), for runs of equal
pieces at a time, and comes out as if the pieces had been placed one by one. A
segment tree over the remaining capacities finds the tightest open window. Pieces of
a length are numbered by Spark, and a piece's number gives its run and its place.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.common import Saved, body, prepared, table

WINDOW = 4096
END_ID = 2
TOKENIZER = "word_bpe_49k.json"
#: Pieces numbered in one group at most, about.
GROUP_ROWS = 20_000
#: Words of a generation whose ids a Python worker keeps: two take about 120 MB.
KEPT_WORDS = 300_000


class WordIds:
    """Ids of texts, looked up word by word.

    The tokenizer drops white space and joins nothing across it, so the ids of a text
    are those of its words. Words are kept in two generations: what is met again moves
    to the young one, and when that is full the old one is forgotten.

    Most new words are Latin letters, with marks after them or not. If the tokenizer
    ignores their case, takes a run of them as one unit and parts marks from it, all of
    which is tried out first, its model gets the letters as they are, without the much
    slower normalising and splitting; everything else takes the whole way.

    A text that holds an added token of the tokenizer (`<|endoftext|>`), which is found in
    the text as it is, inside words too, is not split but encoded whole.
    """

    def __init__(self, path: str | None):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # the tasks keep all cores busy
        from tokenizers import Tokenizer, pre_tokenizers

        if path is None:
            import public_tokenizers

            path = public_tokenizers.path(TOKENIZER)
        self.whole = Tokenizer.from_file(path)
        self.tokenizer = Tokenizer.from_file(path)  # for words: lower-cased, one may look like an added token
        self.tokenizer.encode_special_tokens = True
        self.added = [t.content.encode() for t in self.whole.get_added_tokens_decoder().values()]
        self.model = self.tokenizer.model
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        units = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.marks: dict[str, bytes] = {}
        self.letters = {ord(c): units.pre_tokenize_str(c)[0][0] for c in map(chr, range(97, 0x250)) if c.isalpha() and c == c.lower()}
        self.plain = re.compile(f"([{''.join(map(chr, self.letters))}]+)([.,;:!?]*)").fullmatch
        trials = ["a", "the", "nation", "\u00e9t\u00e9", "stra\u00dfe", "\u0159eka", "qzxv\u00f1\u00f8"]
        self.direct = all(
            self._letters(t) == self._whole(t) == self._whole(t.upper() if "\u00df" not in t else t)
            and self._whole(t) + self._whole(m) == self._whole(t + m) for t in trials for m in (",", ".", "!?", ":;"))

    def _whole(self, text: str) -> bytes:
        found = self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0]
        return array("I", found.ids).tobytes()

    def _letters(self, text: str) -> bytes:
        units = text if text.isascii() else text.translate(self.letters)
        return array("I", [t.id for t in self.model.tokenize(units)]).tobytes()

    def _learn(self, words: set[bytes]) -> None:
        young, old, odd = self.young, self.old, []
        for word in words:
            if (ids := old.get(word)) is None:
                plain = self.plain(word.decode("utf-8", "replace").lower()) if self.direct else None
                if plain is None:
                    odd.append(word)
                    continue
                text, marks = plain.groups()
                core = text.encode()
                if (ids := young.get(core) or old.get(core)) is None:
                    ids = self._letters(text)
                if marks:
                    young[core] = ids
                    if marks not in self.marks:
                        self.marks[marks] = self._whole(marks)
                    ids += self.marks[marks]
            young[word] = ids
        if odd:
            found = self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in odd], add_special_tokens=False)
            young.update(zip(odd, (array("I", e.ids).tobytes() for e in found)))

    def __call__(self, texts: list[bytes]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of texts in UTF-8."""
        odd = [i for i, text in enumerate(texts) if any(token in text for token in self.added)]
        if odd:
            whole = set(odd)
            rest = [text for i, text in enumerate(texts) if i not in whole]
            found = self.whole.encode_batch_fast([texts[i].decode("utf-8", "replace") for i in odd], add_special_tokens=False)
            out = self(rest)
            for i, encoding in zip(odd, found):
                out.insert(i, array("I", encoding.ids).tobytes())
            return out
        split = [(text.lower() if self.direct else text).split() for text in texts]
        if len(self.young) > KEPT_WORDS:
            self.old, self.young = self.young, {}
        if len(self.marks) > KEPT_WORDS:
            self.marks.clear()
        self._learn(set().union(*split).difference(self.young))
        known = self.young.__getitem__
        return [b"".join(map(known, words)) for words in split]


_LOADED: dict[str | None, WordIds] = {}


def _encoder(path: str | None) -> WordIds:
    """One per Python worker, kept from task to task."""
    if path not in _LOADED:
        _LOADED[path] = WordIds(path)
    return _LOADED[path]


def tokenized(
    docs: DataFrame, id_col: str, text_col: str, tokenizer_path: str | None, end_id: int, window: int
) -> DataFrame:
    """Pieces (doc_id, start, length, doc_tokens, ids) of at most `window` ids."""
    end = np.array([end_id], "<u4").tobytes()
    size = 4 * window

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(tokenizer_path)
        for batch in batches:
            rows, starts, totals, pieces = [], [], [], []
            for row, ids in enumerate(encode(batch.column(1).to_pylist())):
                ids += end
                for at in range(0, len(ids), size):
                    rows.append(row)
                    starts.append(at // 4)
                    totals.append(len(ids) // 4)
                    pieces.append(ids[at:at + size])
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(rows, pa.int64())), pa.array(starts, pa.int64()),
                pa.array([len(p) // 4 for p in pieces], pa.int64()), pa.array(totals, pa.int64()),
                pa.array(pieces, pa.binary()),
            ], names=["doc_id", "start", "length", "doc_tokens", "ids"])

    given = docs.select(F.col(id_col).alias("doc_id"), body(F.col(text_col)).alias("text"))
    schema = T.StructType([
        T.StructField("doc_id", given.schema["doc_id"].dataType), T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()), T.StructField("doc_tokens", T.LongType()),
        T.StructField("ids", T.BinaryType()),
    ])
    return given.mapInArrow(cut, schema)


class _Tree:
    """Which remaining capacities, 1 to `top`, have an open window."""

    def __init__(self, top: int):
        self.base = 1 << top.bit_length()
        self.any = bytearray(2 * self.base)

    def set(self, at: int, value: bool) -> None:
        at += self.base
        self.any[at] = value
        while at := at // 2:
            self.any[at] = self.any[2 * at] or self.any[2 * at + 1]

    def first(self, least: int) -> int:
        """The smallest capacity of `least` or more, 0 if there is none."""
        at = least + self.base
        if self.any[at]:
            return least
        while at > 1 and not (at % 2 == 0 and self.any[at + 1]):
            at //= 2
        if at <= 1:
            return 0
        at += 1
        while at < self.base:
            at = 2 * at if self.any[2 * at] else 2 * at + 1
        return at - self.base


@dataclass
class Plan:
    """Runs of equal pieces, by the number of their first piece among all pieces
    ordered by length: `each` pieces go into a window one after the other, from
    `offset` on, then on to the next window number."""

    first: np.ndarray
    length: np.ndarray
    window: np.ndarray
    each: np.ndarray
    offset: np.ndarray
    windows: int


def best_fit_decreasing(counts: dict[int, int], window: int) -> Plan:
    """Where the pieces go, given how many there are of each length."""
    tree = _Tree(window)
    open_: list[list[tuple[int, int]]] = [[] for _ in range(window + 1)]  # (first window, windows) by capacity
    runs, used = [], 0
    before, total = {}, 0
    for length in sorted(counts):
        before[length], total = total, total + counts[length]

    def give(capacity: int, first: int, n: int) -> None:
        if capacity and n:
            open_[capacity].append((first, n))
            tree.set(capacity, True)

    for length in sorted(counts, reverse=True):
        at, left = before[length], counts[length]
        while left:
            capacity = tree.first(length)
            if capacity:
                first, n = open_[capacity].pop()
                if not open_[capacity]:
                    tree.set(capacity, False)
            else:
                capacity, first, n = window, used, left
            each = capacity // length
            full = min(n, left // each)
            rest = left - full * each if full < n else 0
            runs.append((at, length, first, each, window - capacity))
            if capacity == window:
                used += full + bool(rest)
            else:
                give(capacity, first + full + bool(rest), n - full - bool(rest))
            give(capacity - each * length, first, full)
            if rest:
                give(capacity - rest * length, first + full, 1)
            at, left = at + full * each + rest, left - full * each - rest
    runs.sort()
    return Plan(*(np.array([r[i] for r in runs], np.int64) for i in range(5)), windows=used)


@dataclass
class Packing:
    """`pieces`: piece_id, doc_id, start, length, doc_tokens and `ids` (little-endian
    unsigned 32-bit). `places`: piece_id, sequence_id, offset. Both rest on tables in
    the shared folder."""

    pieces: DataFrame
    places: DataFrame
    windows: int

    def sequences(self) -> DataFrame:
        """(sequence_id, ids): a window's pieces one after the other. A window holds
        at most as many pieces as ids."""
        put = self.places.join(self.pieces.select("piece_id", "ids"), "piece_id")
        parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
        return put.groupBy("sequence_id").agg(
            F.concat(F.lit(b""), F.aggregate(
                parts, F.lit(b""), lambda done, p: F.concat(done, p["ids"]))).alias("ids"))


def pack(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer_path: str | None = None,
    end_id: int = END_ID, window: int = WINDOW,
) -> Packing:
    """Tokenize whole documents and pack them.

    Null and blank texts are the end id alone. Longer documents are first cut into
    full windows and a rest. Repeated rows and null ids are packed like any other; no
    documents give no pieces. Other columns are not looked at.
    """
    spark = prepared(docs.sparkSession)
    cut = tokenized(docs, id_col, text_col, tokenizer_path, end_id, window)
    pieces = Saved(cut.withColumn("piece_id", F.monotonically_increasing_id()), "pieces", "zstd").df
    counts = {r.length: r.n for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = best_fit_decreasing(counts, window)

    groups = 1 + sum(counts.values()) // GROUP_ROWS
    dealt = pieces.select("piece_id", "length", F.pmod(F.xxhash64("piece_id"), F.lit(groups)).alias("part"))
    sizes = dealt.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("length", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    shorter, total = [], 0
    for length in sorted(counts):
        shorter.append((length, total))
        total += counts[length]
    below = spark.createDataFrame(shorter, "length long, below long")  # at most `window` rows
    starts = starts.join(F.broadcast(below), "length").select("length", "part", (F.col("base") + F.col("below")).alias("base"))
    order = Window.partitionBy("length", "part").orderBy("piece_id")
    numbered = dealt.withColumn("rank", F.row_number().over(order) - 1).join(starts, ["length", "part"]).select(
        "piece_id", (F.col("base") + F.col("rank")).alias("number"))

    @F.pandas_udf("sequence_id long, offset long")
    def place(number: pd.Series) -> pd.DataFrame:
        n = number.to_numpy(np.int64)
        run = np.searchsorted(plan.first, n, "right") - 1
        turn, at = np.divmod(n - plan.first[run], plan.each[run])
        return pd.DataFrame({
            "sequence_id": plan.window[run] + turn, "offset": plan.offset[run] + at * plan.length[run]})

    places = numbered.select("piece_id", place("number").alias("p")).select("piece_id", "p.sequence_id", "p.offset")
    return Packing(pieces, places, plan.windows)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each piece of every document lies, and the checksum of its ids."""
    packed = pack(table(prepared(spark), sf_dir, "documents"))
    digest = packed.pieces.select(
        "piece_id", "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens")
    return digest.join(packed.places, "piece_id").drop("piece_id")
