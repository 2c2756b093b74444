"""Passages of benchmark items in documents, by edit distance over words.

An item of m words may differ by k = m // 5 inserted, lost or changed words; one of fewer
than five words must be there as it is. Cut into k + 1 pieces, at least one piece is left whole by k edits, so an Aho-Corasick
automaton over all pieces finds every place worth a look in one pass over a text. There
Myers' bit-parallel recurrence gives the distance of the item to every end of a
passage, word by word, each column being one arbitrarily long integer.

Words are runs of letters, digits and underscores, lower-cased: upper case, line
breaks and punctuation do not hide a passage.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator, Sequence
from itertools import accumulate

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import Saved, prepared, table

#: Words of an item for each allowed edit.
WORDS_PER_EDIT = 5
#: Characters of items held by the driver and sent to the tasks at once, about; larger
#: benchmarks go in several passes over the documents.
BLOCK_CHARS = 8_000_000

LEAK = "array<struct<item: long, first_word: int, end_word: int, distance: int>>"
_LEAK = pa.list_(pa.struct([("item", pa.int64()), *((n, pa.int32()) for n in ("first_word", "end_word", "distance"))]))
_words = re.compile(r"\w+").findall


def words_of(text: str | None) -> list[str]:
    return _words((text or "").lower())


def budget(m: int) -> int:
    return m // WORDS_PER_EDIT


def distances(item: dict[str, int], m: int, words: Sequence[str], anchored: bool = False) -> Iterator[int]:
    """The item's distance to the best passage that ends with each word.

    `item` has the positions of each word as a bit mask. `anchored`: the passage
    begins with the first word.
    """
    full, last = (1 << m) - 1, 1 << (m - 1)
    up, down, score = full, 0, m
    for word in words:
        eq = item.get(word, 0)
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        plus = (down | ~(xh | up)) & full
        minus = up & xh
        score += bool(plus & last) - bool(minus & last)
        plus = (plus << 1) | anchored
        minus <<= 1
        up = (minus | ~(xv | plus)) & full
        down = plus & xv & full
        yield score


def _mask(words: Sequence[str]) -> dict[str, int]:
    mask: dict[str, int] = defaultdict(int)
    for i, word in enumerate(words):
        mask[word] |= 1 << i
    return dict(mask)


class Searcher:
    """Finds the items (lists of words) in texts."""

    def __init__(self, items: Sequence[Sequence[str]]):
        self.items = [(len(w), budget(len(w)) if w else 0, _mask(w), _mask(w[::-1])) for w in items]
        pieces: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for n, words in enumerate(items):
            m, k = self.items[n][:2]
            for i in range(k + 1 if words else 0):
                first = i * m // (k + 1)
                pieces[" " + " ".join(words[first:(i + 1) * m // (k + 1)]) + " "].append((n, first))
        self.pieces = ahocorasick.Automaton()
        for piece, at in pieces.items():
            self.pieces.add_word(piece, (len(piece), at))
        if pieces:
            self.pieces.make_automaton()

    def __call__(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """(item, first word, word after the last, distance) of each passage, one for
        each stretch of ends within the budget: its nearest, of equal ones the first."""
        if not len(self.pieces):
            return []
        words = words_of(text)
        line = " " + " ".join(words) + " "
        hits = list(self.pieces.iter(line))
        if not hits:
            return []
        starts = np.fromiter(accumulate((len(w) + 1 for w in words), initial=0), np.int64, len(words) + 1)
        where: dict[int, set[int]] = defaultdict(set)
        for end, (size, at) in hits:
            word = int(np.searchsorted(starts, end - size + 1))
            for n, first in at:
                where[n].add(word - first)
        found = []
        for n in sorted(where):
            m, k, mask, turned = self.items[n]
            spans: list[list[int]] = []
            for at in sorted(where[n]):
                lo, hi = max(0, at - k), min(len(words), at + m + k)
                if spans and lo <= spans[-1][1]:
                    spans[-1][1] = max(hi, spans[-1][1])
                else:
                    spans.append([lo, hi])
            for lo, hi in spans:
                best: tuple[int, int] | None = None
                for end, d in enumerate([*distances(mask, m, words[lo:hi]), k + 1], lo + 1):
                    if d <= k and (best is None or d < best[0]):
                        best = (d, end)
                    elif d > k and best:
                        back = words[max(lo, best[1] - m - k):best[1]][::-1]
                        size = next(i for i, x in enumerate(distances(turned, m, back, True), 1) if x == best[0])
                        found.append((n, best[1] - size, best[1], best[0]))
                        best = None
        return found


def _numbered(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The items in the shared folder, each with a number of its own."""
    number = F.monotonically_increasing_id().alias("number")
    text = F.col(text_col).cast("string").alias("text")
    return Saved(benchmark.select(number, F.col(id_col).alias("item_id"), text), "items").df


def _blocks(items: DataFrame) -> Iterator[list[tuple[int, list[str]]]]:
    """The items with their numbers, in blocks of about `BLOCK_CHARS` dealt by hash. The
    driver holds one at a time."""
    n = -(-(items.agg(F.sum(F.length("text"))).first()[0] or 0) // BLOCK_CHARS) or 1
    for block in range(n):
        rows = items.where(F.pmod(F.xxhash64("number"), F.lit(n)) == block).select("number", "text").collect()
        yield [(r.number, words_of(r.text)) for r in sorted(rows, key=lambda r: r.number)]


def leaks(text: Column, block: Sequence[tuple[int, Sequence[str]]]) -> Column:
    """The passages in a text of numbered items, each as that number, words and distance."""
    made: list[Searcher] = []

    @F.arrow_udf(LEAK)
    def search(texts: pa.Array) -> pa.Array:
        if not made:
            made.append(Searcher([words for _, words in block]))
        names = ("item", "first_word", "end_word", "distance")
        return pa.array([[dict(zip(names, (block[n][0], *x))) for n, *x in made[0](t.as_py())] for t in texts], _LEAK)

    return search(text.cast("string"))


def contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """(doc_id, item_id, first_word, end_word, distance) of each passage found.

    Null or wordless texts and items match nothing. An item of fewer than five words
    must be there as it is. Rows that repeat are answered each time; null ids stay null.
    Of a benchmark of several blocks, the passages of each are written before the next.
    """
    spark = prepared(docs.sparkSession)
    items = _numbered(benchmark, item_col, item_text_col)
    found, paths = None, []
    for block in _blocks(items):
        if found is not None:
            paths.append(Saved(found, "leaks").path)
        found = docs.select(F.col(id_col).alias("doc_id"), F.explode(leaks(F.col(text_col), block)).alias("leak"))
    if paths:
        found = spark.read.schema(found.schema).parquet(*paths, Saved(found, "leaks").path)
    named = found.join(items.select("number", "item_id"), F.col("leak.item") == F.col("number"))
    return named.select("doc_id", "item_id", "leak.first_word", "leak.end_word", "leak.distance")


def without_leaks(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text"
) -> DataFrame:
    """`docs` without those that hold a passage of any item. Of a benchmark of several
    blocks, what each leaves is written before the next.

    Null and empty texts hold nothing and stay, null and empty items are nowhere; an empty
    benchmark leaves all. Rows that repeat are each judged, columns stay as they are.
    """
    prepared(docs.sparkSession)
    before = None
    for n, block in enumerate(_blocks(_numbered(benchmark, item_col, item_text_col))):
        if n:
            after = Saved(docs, "clean")
            if before:
                before.drop()
            docs, before = after.df, after
        docs = docs.where(F.size(leaks(F.col(text_col), block)) == 0)
    return docs


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every passage of a benchmark item in every document."""
    prepared(spark)
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
