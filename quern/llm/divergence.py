"""How far the term use of each source is from its language's other sources.

Texts become bytes, bytes become terms, and terms become numbers: one of up to 8 bytes
is one unsigned 64-bit word (big-endian, padded with zero bytes, which no term holds),
one of up to 16 bytes is two. A radix sort brings equal ones together and their runs are
counted, all in numpy. Longer terms go to a bucket per rounded-up length and are sorted
there as bytes. What a task hands on is one row per group and term it has seen.

Sources are compared in cells of bounded size, a block of terms by two blocks of
sources. A term that a source does not use has the same share as every other such term,
so only used terms are shuffled, and a cell fills the rest in itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm.common import Saved, body, prepared, table

LEAST_DOCS = 10
TOP_TERMS = 10
SCALE = 1_000_000_000
#: Bytes of text counted at once; longer texts are counted in slices.
SLICE = 1 << 22
#: Sources, and terms, of a cell.
SOURCE_BLOCK, TERM_BLOCK = 256, 1024

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IN_TERM = np.zeros(256, bool)
_IN_TERM[65:91] = _IN_TERM[97:123] = _IN_TERM[128:] = True


def radix_order(*keys: np.ndarray) -> np.ndarray:
    """The stable order by the first key, then the second, and so on, by 16 bits at a
    time from the lowest (numpy sorts numbers of 16 bits stably by radix). Digits that all
    numbers share are passed over."""
    order = np.arange(len(keys[0]))
    for key in reversed(keys):
        unlike = int(np.bitwise_or.reduce(key ^ key[0])) if len(key) else 0
        for shift in range(0, 8 * key.dtype.itemsize, 16):
            if unlike >> shift & 0xFFFF:
                digit = (key >> key.dtype.type(shift)).astype(np.uint16)
                order = order[np.argsort(digit[order], kind="stable")]
    return order


def spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the terms in the bytes begin and end."""
    edges = np.flatnonzero(np.diff(_IN_TERM[data].view(np.int8), prepend=0, append=0))
    return edges[::2], edges[1::2]


def _words(data: np.ndarray, start: np.ndarray, length: np.ndarray, skip: int) -> np.ndarray:
    """Eight bytes of each term from its byte `skip` on, as one number."""
    out = np.zeros(len(start), np.uint64)
    for k in range(skip, skip + 8):
        inside = k < length
        out <<= np.uint64(8)
        out[inside] |= data[start[inside] + k]
    return out


def _runs(order: np.ndarray, keys: list[np.ndarray], doc: np.ndarray, times: np.ndarray) -> tuple:
    """Of equal keys, in order: the first, how often in all, and in how many documents.
    Within equal keys the order must be that of the documents."""
    sorted_keys = [k[order] for k in keys]
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in sorted_keys:
        new[1:] |= k[1:] != k[:-1]
    new_doc = new.copy()
    new_doc[1:] |= doc[order][1:] != doc[order][:-1]
    first = np.flatnonzero(new)
    return order[first], np.add.reduceat(times[order], first), np.add.reduceat(new_doc.astype(np.int64), first)


def counted(data: np.ndarray, start: np.ndarray, end: np.ndarray, group: np.ndarray, doc: np.ndarray) -> Iterator[tuple]:
    """(groups, terms, counts, documents), one bucket of term lengths after the other.
    `group` and `doc` are each term's; documents must not fall."""
    length = end - start
    widths = np.where(length <= 16, (length + 7) // 8, 0)
    for width in (1, 2):
        at = np.flatnonzero(widths == width)
        if len(at):
            keys = [group[at], *(_words(data, start[at], length[at], 8 * i) for i in range(width))]
            one, n, docs = _runs(radix_order(*keys), keys, doc[at], np.ones(len(at), np.int64))
            terms = np.stack([k[one] for k in keys[1:]], axis=1).astype(">u8").view(f"S{8 * width}").ravel()
            yield keys[0][one], terms, n, docs
    at = np.flatnonzero(widths == 0)
    buckets = np.zeros(len(at), np.int64)
    buckets[:] = [int(n - 1).bit_length() for n in length[at]]
    for bucket in np.unique(buckets):
        own = at[buckets == bucket]
        terms = np.array([data[s:e].tobytes() for s, e in zip(start[own], end[own])], dtype=object)
        order = np.array(sorted(range(len(own)), key=lambda i: (group[own[i]], terms[i])), np.int64)
        one, n, docs = _runs(order, [group[own], terms], doc[own], np.ones(len(own), np.int64))
        yield group[own][one], terms[one], n, docs


def _slices(text: bytes) -> Iterator[bytes]:
    """A text in parts of about `SLICE` bytes, cut between terms only."""
    at = 0
    while len(text) - at > SLICE:
        end = at + SLICE
        while end < len(text) and _IN_TERM[text[end]]:
            end += 1
        yield text[at:end]
        at = end
    yield text[at:]


def _table(texts: list[bytes], groups: list[int], codes: list[tuple[str, str]]) -> Iterator[pa.RecordBatch]:
    data = _LOWER[np.frombuffer(b"\0".join(texts), np.uint8)]
    start, end = spans(data)
    begins = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])[:-1]])
    doc = np.searchsorted(begins, start, "right") - 1
    group = np.array(groups, np.uint32)[doc]
    for of, terms, n, docs in counted(data, start, end, group, doc):
        yield _batch([codes[g] for g in of], terms.tolist(), n, docs)


def _batch(groups: list[tuple[str, str]], terms: list[bytes], n: np.ndarray, docs: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([
        pa.array([g[0] for g in groups], pa.string()), pa.array([g[1] for g in groups], pa.string()),
        pa.array(terms, pa.binary()).cast(pa.string()), pa.array(n, pa.int64()), pa.array(docs, pa.int64()),
    ], names=["lang", "source", "term", "n", "docs"])


def _long(text: bytes, group: tuple[str, str]) -> Iterator[pa.RecordBatch]:
    """A text of several slices: the counts of all together, as it is one document."""
    parts: dict[bytes, int] = {}
    for part in _slices(text):
        for batch in _table([part], [0], [group]):
            for term, n in zip(batch["term"].to_pylist(), batch["n"].to_pylist()):
                parts[term] = parts.get(term, 0) + n
    if parts:
        yield _batch([group] * len(parts), [t.encode() for t in parts], np.array(list(parts.values())), np.ones(len(parts)))


def term_counts(docs: DataFrame, text: Column, lang: Column, source: Column) -> DataFrame:
    """(lang, source, term, n, docs): how often a term occurs, and in how many rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, groups, held, codes = [], [], 0, {}
        for batch in batches:
            for group in zip(*(batch.column(i).to_pylist() for i in (1, 2))):
                groups.append(codes.setdefault(group, len(codes)))
            for data in batch.column(0).to_pylist():
                if len(data) > SLICE:
                    yield from _long(data, list(codes)[groups.pop(len(texts))])
                    continue
                texts.append(data)
                held += len(data)
                if held >= SLICE:
                    yield from _table(texts, groups[:len(texts)], list(codes))
                    groups, texts, held = groups[len(texts):], [], 0
        if texts:
            yield from _table(texts, groups, list(codes))

    empty = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    given = docs.select(body(text).alias("text"), empty(lang).alias("lang"), empty(source).alias("source"))
    found = given.mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _share(n: str, total: str, kept: str) -> Column:
    """1 + floor(SCALE · (n + 2) / (total + 2 · kept)), in whole numbers of any size."""
    return F.expr(
        f"1 + (cast({SCALE} as decimal(10,0)) * cast({n} + 2 as decimal(20,0))) div cast({total} + 2 * {kept} as decimal(20,0))")


def _apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def _cell(rows: pd.DataFrame) -> pd.DataFrame:
    """What a cell adds to the distance of each two of its sources. A row without a term
    has the share of all terms its source does not use; the first block of terms counts
    these for all kept terms, and each block puts right those that are used."""
    names = {t: i for i, t in enumerate(sorted(set(rows["term"].dropna())))}
    first, across = rows["part"].iloc[0] == 0, rows["lo"].iloc[0] != rows["hi"].iloc[0]
    sides = []
    for block in sorted({rows["lo"].iloc[0], rows["hi"].iloc[0]}):
        part = rows[rows["block"] == block]
        whole, used = part[part["term"].isna()], part[part["term"].notna()]
        place = {s: i for i, s in enumerate(whole["source"])}
        none = whole["p"].to_numpy(np.int64)
        p = np.repeat(none[:, None], len(names), axis=1)
        p[used["source"].map(place).to_numpy(np.int64), used["term"].map(names).to_numpy(np.int64)] = used["p"]
        sides.append((list(place), none, p))
    a, b, value = [], [], [np.zeros(0, np.int64)]
    if len(sides) == 1 + across and any(s[0] for s in sides):
        kept = int(rows["kept"].max()) if first else 0
        (ones, one_none, one), (others, other_none, other) = sides[0], sides[-1]
        for i, name in enumerate(ones):
            rest = slice(0 if across else i + 1, None)
            a += [name] * len(others[rest])
            b += others[rest]
            unused = _apart(one_none[i], other_none[rest])
            value.append(_apart(one[i], other[rest]).sum(axis=1) + (kept - len(names)) * unused)
    names = {"lang": [rows["lang"].iloc[0]] * len(a), "a": a, "b": b}
    return pd.DataFrame({k: pd.Series(v, dtype=object) for k, v in names.items()} | {"value": np.concatenate(value)})


def pair_divergence(shares: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, a, b, value) of each two sources of a language, once: the sum over all its
    kept terms. `shares` (lang, source, term, p) are those of used terms, `groups` (lang,
    source, kept, none) all sources, the kept terms of their language and the share of an
    unused one."""
    sizes = groups.groupBy("lang").agg(F.count(F.lit(1)).alias("sources"), F.max("kept").alias("kept")).select(
        "kept",
        "lang", (1 + F.floor(F.col("sources") / SOURCE_BLOCK)).cast("int").alias("blocks"),
        (1 + F.floor(F.col("kept") / TERM_BLOCK)).cast("int").alias("parts"))
    block = F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int").alias("block")
    part = F.pmod(F.xxhash64("term"), F.col("parts")).cast("int").alias("part")
    used = shares.join(sizes, "lang").select("lang", "source", "term", "p", "kept", "blocks", block, part)
    whole = groups.join(sizes.drop("kept"), "lang").select(
        "lang", "source", F.lit(None).cast("string").alias("term"), F.col("none").alias("p"), "kept", "blocks", block,
        F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    cells = used.unionByName(whole).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "lang", "source", "term", "p", "kept", "block", "part",
        F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))
    sums = cells.groupBy("lang", "part", "lo", "hi").applyInPandas(_cell, "lang string, a string, b string, value long")
    return sums.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def audit(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
    least_docs: int = LEAST_DOCS, top: int = TOP_TERMS,
) -> DataFrame:
    """(lang, source, part, item, value, rank): part `pair` has each other source of the
    language, the furthest first; part `term` the `top` terms the source uses more than
    its language does, by what they add to the distance between the two.

    Terms are runs of letters and other characters beyond ASCII, only A-Z lower-cased.
    Those in `least_docs` rows of a language count. Null texts, languages and sources are
    read as empty; a source without terms is still compared, and a language that keeps no
    term has its sources 0 apart. Rows that repeat count each time; no rows give no rows.
    Other columns are not looked at.
    """
    prepared(docs.sparkSession)
    counts = Saved(term_counts(docs, F.col(text_col), F.col(lang_col), F.col(source_col)), "terms").df
    empty = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(""))
    sources = Saved(docs.select(empty(lang_col).alias("lang"), empty(source_col).alias("source")).distinct(), "sources").df

    kept = Saved(counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"))
                 .where(F.col("docs") >= least_docs).select("lang", "term", "n"), "kept").df
    sizes = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("n").alias("all"))
    used = counts.select("lang", "source", "term", "n").join(kept.select("lang", "term", F.col("n").alias("in_lang")), ["lang", "term"])
    totals = used.groupBy("lang", "source").agg(F.sum("n").alias("own"))
    groups = Saved(sources.join(totals, ["lang", "source"], "left").join(sizes, "lang", "left").na.fill(0).withColumn(
        "none", F.when(F.col("kept") > 0, _share("0", "own", "kept")).otherwise(1).cast("long")), "groups").df
    shares = Saved(used.join(groups.drop("none"), ["lang", "source"]).select(
        "lang", "source", "term", _share("n", "own", "kept").alias("p"), _share("in_lang", "all", "kept").alias("q")), "shares").df

    pairs = pair_divergence(shares.select("lang", "source", "term", "p"), groups)
    both = pairs.select("lang", F.explode(F.array(
        F.struct(F.col("a").alias("source"), F.col("b").alias("item")),
        F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("of"), "value")
    both = both.select("lang", "of.source", F.lit("pair").alias("part"), "of.item", "value")
    gap = F.expr("cast((p - q) * (p - q) div (p + q) as long)")
    marked = shares.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), gap.alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    marked = marked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return both.withColumn("rank", F.row_number().over(order)).unionByName(marked)


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every source of every language against the others and against the language."""
    return audit(table(prepared(spark), sf_dir, "documents"))


_TERM_CLASS = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
_AZ = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

OP11_SQL = f"""
with given as (
  select row_number() over () as row, coalesce(lang, '') as lang, coalesce(source, '') as source,
         translate(coalesce(text, ''), '{_AZ[0]}', '{_AZ[1]}') as text
  from documents),
terms as (select row, lang, source, unnest(regexp_extract_all(text, '{_TERM_CLASS}')) as term from given),
kept as (select lang, term, count(*) as n from terms group by lang, term having count(distinct row) >= {LEAST_DOCS}),
used as (select lang, source, term, count(*) as n from terms semi join kept using (lang, term) group by all),
sizes as (select lang, count(*) as v, sum(n) as total from kept group by lang),
groups as (
  select lang, source, coalesce(sum(n), 0) as total
  from (select distinct lang, source from given) left join used using (lang, source) group by lang, source),
p as (
  select g.lang, g.source, k.term, coalesce(u.n, 0) as n,
         1 + ({SCALE}::hugeint * (coalesce(u.n, 0) + 2)::hugeint // (g.total + 2 * s.v)::hugeint) as p,
         1 + ({SCALE}::hugeint * (k.n + 2)::hugeint // (s.total + 2 * s.v)::hugeint) as q
  from groups g join kept k using (lang) join sizes s using (lang)
       left join used u on u.lang = g.lang and u.source = g.source and u.term = k.term),
pairs as (
  select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) as value
  from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
pair as (
  select a.lang, a.source, 'pair' as part, b.source as item, coalesce(x.value, 0)::bigint as value
  from groups a join groups b on a.lang = b.lang and a.source <> b.source
       left join pairs x on x.lang = a.lang and x.source = a.source and x.item = b.source),
term as (
  select lang, source, 'term' as part, term as item, ((p - q) * (p - q) // (p + q))::bigint as value
  from p where n > 0 and p > q),
ranked as (
  select *, row_number() over (partition by lang, source, part order by value desc, item)::integer as rank
  from (select * from pair union all select * from term))
select lang, source, part, item, value, rank from ranked where part = 'pair' or rank <= {TOP_TERMS}
"""
