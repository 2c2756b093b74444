"""Scores of documents under a bigram model learnt from the corpus itself.

Texts are cut into blocks of about a million tokens. A block asks for what it needs to
know, and only for that: first how often each of its words occurs in the training
texts, then what is stored for each of its word pairs. Questions go to shards by hash,
answers come back by block. No task holds more than a block or a shard, both of bounded
size, and a word or pair is sent once per block however often it occurs there.

A shard of pairs adds up the counts of all blocks and stores them as a two-level trie
(see elias_fano): contexts, and their successors with the quantised probability of a
word given its context. The pairs of a very frequent context are dealt out over several
shards. The probability is smoothed towards the word's own,

    p(w | v) = (c(v) · share(w | v) + prior · p(w)) / (c(v) + prior),

and sums up to one. The strength of the prior is the one of `PRIORS` under which the
training pairs, each left out of the counts in turn, are likeliest; the shards add that
up over all pairs.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.common import Saved, body, prepared, settle, table
from quern.llm.elias_fano import Trie

#: Tokens of a block; a longer document is a block of its own.
BLOCK_TOKENS = 1 << 20
#: Training and other tokens per shard of words, and per shard of pairs.
WORD_SHARD = 1 << 23
PAIR_SHARD = 1 << 21
#: Occurrences of a context from which its pairs go to several shards.
FREQUENT = 1 << 17
#: Strengths tried for the prior.
PRIORS = tuple(10 ** (i / 2) for i in range(-1, 15))
#: Steps of a quantised probability per power of ten.
STEPS = 4096
_RANK_BITS = 24
_END = xxhash.xxh64_intdigest(b"\n")  # no word holds white space
_MIX = np.uint64(0x9E3779B97F4A7C15)
_PART = "block long, shard int, payload binary"


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays in their narrowest unsigned types, compressed together."""
    out = []
    for a in arrays:
        if a.dtype.kind == "u" or a.dtype.kind == "i":
            most = int(a.max()) if len(a) else 0
            a = a.astype(next(t for t in ("u1", "u2", "u4", "u8") if most <= np.iinfo(t).max))
        out.append(struct.pack("<2sq", a.dtype.str[1:].encode(), len(a)) + a.tobytes())
    raw = b"".join(out)
    return struct.pack("<q", len(raw)) + pa.compress(raw, codec="zstd", asbytes=True)


def unpacked(payload: bytes) -> list[np.ndarray]:
    size = struct.unpack_from("<q", payload)[0]
    raw = pa.decompress(payload[8:], decompressed_size=size, codec="zstd", asbytes=True)
    at, out = 0, []
    while at < len(raw):
        kind, n = struct.unpack_from("<2sq", raw, at)
        kind = np.dtype(kind.decode())
        at += 10
        out.append(np.frombuffer(raw, kind, n, at))
        at += n * kind.itemsize
    return out


def _range_shard(hashes: np.ndarray, shards: int) -> np.ndarray:
    """Bounds of the shards in rising 64-bit hashes; a shard has a range of them."""
    edges = np.array([(i << 64) // shards for i in range(1, shards)], np.uint64)
    return np.concatenate([[0], np.searchsorted(hashes, edges), [len(hashes)]])


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64) * _MIX
    x ^= x >> np.uint64(32)
    x *= _MIX
    return x ^ (x >> np.uint64(29))


def tokens(text: bytes) -> list[bytes]:
    """A text's words; the end that follows them is added by the caller."""
    return text.lower().split()


class _Block:
    """Documents gathered until there are enough tokens."""

    def __init__(self):
        self.ids, self.sizes, self.held = [], [], []
        self.codes, self.known = [], {}
        self.n = 0

    def add(self, doc_id, text: bytes, held: bool) -> None:
        known = self.known
        words = tokens(text)
        codes = np.fromiter((known.setdefault(w, len(known)) for w in words), np.uint32, len(words))
        self.codes += [codes, np.array([known.setdefault(b"\n", len(known))], np.uint32)]
        self.ids.append(doc_id)
        self.sizes.append(len(words) + 1)
        self.held.append(held)
        self.n += len(words) + 1

    def rows(self, block: int, shards: int) -> Iterator[tuple[int, int, list, bytes]]:
        """The state of the block (shard -1), and its questions to the word shards: the
        hashes of its words, rising, and how often each occurs in training texts."""
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, self.known), np.uint64, len(self.known))
        order = np.argsort(hashes)
        place = np.empty(len(order), np.uint32)
        place[order] = np.arange(len(order), dtype=np.uint32)
        codes, hashes = place[np.concatenate(self.codes)], hashes[order]
        held = np.array(self.held)
        trained = np.bincount(codes[np.repeat(~held, self.sizes)], minlength=len(hashes))
        yield block, -1, self.ids, packed(np.array(self.sizes), held.astype(np.uint8), codes)
        cut = _range_shard(hashes, shards)
        for shard in np.flatnonzero(np.diff(cut)).tolist():  # so never more rows than words
            part = slice(cut[shard], cut[shard + 1])
            yield block, shard, [], packed(hashes[part], trained[part])


def _blocks(docs: DataFrame, shards: int) -> DataFrame:
    """(block, shard, ids, payload): see `_Block.rows`."""
    kind = docs.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, block, now = 0, TaskContext.get().partitionId() << 32, _Block()

        def out(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([
                pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()),
                pa.array([r[2] for r in rows], pa.list_(arrow)), pa.array([r[3] for r in rows], pa.binary()),
            ], names=["block", "shard", "ids", "payload"])

        for batch in batches:
            arrow = batch.column(0).type
            for doc_id, text, held in zip(*(c.to_pylist() for c in batch.columns)):
                now.add(doc_id, text, held)
                if now.n >= BLOCK_TOKENS:
                    yield out(list(now.rows(block + made, shards)))
                    made, now = made + 1, _Block()
        if now.n:
            yield out(list(now.rows(block + made, shards)))

    schema = T.StructType([
        T.StructField("block", T.LongType()), T.StructField("shard", T.IntegerType()),
        T.StructField("ids", T.ArrayType(kind)), T.StructField("payload", T.BinaryType())])
    return docs.mapInArrow(run, schema)


def _merge_words(asked: pd.DataFrame) -> pd.DataFrame:
    """A shard of words: per block the number and count of each word it asked for, and
    for block -1 the shard's training tokens and distinct words."""
    asked = asked.sort_values("block")
    parts = [unpacked(p) for p in asked["payload"]]
    shard = int(asked["shard"].iloc[0])
    hashes, place = np.unique(np.concatenate([p[0] for p in parts]).astype(np.uint64), return_inverse=True)
    counts = np.bincount(place, np.concatenate([p[1] for p in parts]), len(hashes)).astype(np.uint64)
    ends = np.cumsum([len(p[0]) for p in parts])
    rows = [(-1, shard, packed(np.array([counts.sum()]), np.array([(counts > 0).sum()])))]
    for block, at in zip(asked["block"], np.split(place, ends[:-1])):
        # 0 is the begin of a text, so numbers start at 1
        number = (np.uint64(shard) << np.uint64(_RANK_BITS)) + at.astype(np.uint64) + np.uint64(1)
        rows.append((block, shard, packed(number, counts[at])))
    return pd.DataFrame(rows, columns=["block", "shard", "payload"])


class _Pairs:
    """A block's tokens with what the word shards said of them, and its distinct pairs."""

    def __init__(self, state: bytes, answers: pd.DataFrame, begins: int):
        sizes, held, codes = unpacked(state)
        self.sizes, self.held = sizes.astype(np.int64), held.astype(bool)
        codes = codes.astype(np.int64)
        said = [unpacked(p) for p in answers.sort_values("shard")["payload"]]
        number = np.concatenate([p[0] for p in said] + [[0]]).astype(np.uint64)
        count = np.concatenate([p[1] for p in said] + [[begins]]).astype(np.int64)
        first = np.concatenate([[0], np.cumsum(self.sizes)[:-1]])
        context = np.concatenate([[0], codes[:-1]])
        context[first] = len(number) - 1
        self.first, self.count = first, count[codes]
        pairs, self.pair = np.unique(context * len(number) + codes, return_inverse=True)
        v, w = np.divmod(pairs, len(number))
        self.v, self.w, self.cv, self.cw = number[v], number[w], count[v], count[w]
        trained = np.repeat(~self.held, self.sizes)
        self.trained = np.bincount(self.pair[trained], minlength=len(pairs))

    def dealt(self, shards: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs that can be in the model, by shard, and the bounds of the shards. The
        begin of a text comes last of the contexts, all else rises within a shard."""
        known = np.flatnonzero((self.cv > 0) & (self.cw > 0))
        v, w, cv = self.v[known], self.w[known], self.cv[known].astype(np.uint64)
        salt = _mixed(w) % (np.uint64(1) + cv // np.uint64(FREQUENT))
        shard = (_mixed(_mixed(v) + salt) % np.uint64(shards)).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        return known[order], np.searchsorted(shard[order], np.arange(shards + 1))


def _share_code(count: np.ndarray, of: np.ndarray) -> np.ndarray:
    """A probability as a number from 1 on: steps below one on a logarithmic scale."""
    return (1 + np.minimum(np.rint(-np.log10(count / of) * STEPS), 65534)).astype(np.uint16)


def _share(code: np.ndarray) -> np.ndarray:
    return np.where(code > 0, 10 ** ((1.0 - code) / STEPS), 0.0)


def _merge_pairs(asked: pd.DataFrame, total: int) -> pd.DataFrame:
    """A shard of pairs: its trie, per block the codes asked for, and for block -1 the
    log-likelihood of its training pairs under each prior. `total`: N + V + 1."""
    asked = asked.sort_values("block")
    shard = int(asked["shard"].iloc[0])
    parts = [unpacked(p) for p in asked["payload"]]
    sizes = [len(p[3]) for p in parts]
    contexts, place_v = np.unique(np.concatenate([np.repeat(v.astype(np.uint64), n) for v, n, *_ in parts]), return_inverse=True)
    words, place_w = np.unique(np.concatenate([p[3].astype(np.uint64) for p in parts]), return_inverse=True)
    key = place_v.astype(np.uint64) * np.uint64(len(words)) + place_w.astype(np.uint64)
    del place_v, place_w
    keys, one, place = np.unique(key, return_index=True, return_inverse=True)
    del key
    count = np.bincount(place, np.concatenate([p[5] for p in parts]), len(keys))
    cv = np.concatenate([np.repeat(c.astype(np.int64), n) for _, n, c, *_ in parts])[one]
    cw = np.concatenate([p[4].astype(np.int64) for p in parts])[one]
    del one, parts

    v, w = np.divmod(keys, np.uint64(len(words)))
    seen = count > 0
    known_v, at_v = np.unique(v[seen], return_inverse=True)
    known_w, at_w = np.unique(w[seen], return_inverse=True)
    stored = at_v.astype(np.uint64) * np.uint64(max(1, len(known_w))) + at_w.astype(np.uint64)
    n, of, low = count[seen], cv[seen], (cw[seen] + 1) / total
    trie = Trie(contexts[known_v], words[known_w], stored, _share_code(n, of))
    left_out = [float((n * np.log10((n - 1 + m * low) / (of - 1 + m))).sum()) for m in PRIORS]
    # however many blocks ask for a pair, it is looked up once, and in the trie's order
    codes = trie.reader().look_up(contexts[v], words[w])
    rows = [(-1, shard, packed(np.array(left_out)))]
    rows += [(block, shard, packed(codes[at])) for block, at in zip(asked["block"], np.split(place, np.cumsum(sizes)[:-1]))]
    return pd.DataFrame(rows, columns=["block", "shard", "payload"])


def _questions(pairs: _Pairs, block: int, shards: int) -> pd.DataFrame:
    order, cut = pairs.dealt(shards)
    rows = []
    for shard in np.flatnonzero(np.diff(cut)):
        at = order[cut[shard]:cut[shard + 1]]
        v = pairs.v[at]
        new = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
        rows.append((block, int(shard), packed(
            v[new], np.diff(np.append(new, len(v))), pairs.cv[at][new], pairs.w[at], pairs.cw[at], pairs.trained[at])))
    return pd.DataFrame(rows, columns=["block", "shard", "payload"])


def score_documents(
    docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, prior).

    The model is learnt from the rows where `held_out` is false, and scores all. Null
    and blank texts have the end as their only token; a null `held_out` counts as false.
    Rows that repeat count and are scored each time. No documents give no rows; without
    training texts every token is unknown.
    """
    spark = prepared(docs.sparkSession)
    given = docs.select(
        F.col(id_col).alias("doc_id"), body(F.col(text_col)).alias("text"),
        F.coalesce(held_out, F.lit(False)).alias("held"))
    # words are at least a character and a space long; four bytes a token is a fair guess
    size = given.agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("bytes"),
                     F.sum((~F.col("held")).cast("long")).alias("begins")).first()
    about = size.n + (size.bytes or 0) // 4
    word_shards, pair_shards = 1 + about // WORD_SHARD, 1 + about // PAIR_SHARD
    begins = size.begins or 0
    blocks = Saved(_blocks(given, word_shards), "blocks", "uncompressed").df
    states = blocks.where("shard = -1").select("block", "ids", "payload")
    asked = blocks.where("shard >= 0").select("block", "shard", "payload")

    words = Saved(asked.groupBy("shard").applyInPandas(_merge_words, _PART), "words", "uncompressed").df
    totals = [unpacked(r.payload) for r in words.where("block = -1").select("payload").toLocalIterator()]
    settle(spark)
    n_train, n_distinct = (int(sum(int(t[i][0]) for t in totals)) for i in (0, 1))
    total = n_train + n_distinct + 1

    def ask(key: tuple, state: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        return _questions(_Pairs(state["payload"].iloc[0], answers, begins), key[0], pair_shards)

    known = words.where("block >= 0")
    of_pairs = states.select("block", "payload").groupBy("block").cogroup(known.groupBy("block")).applyInPandas(ask, _PART)
    told = Saved(of_pairs.groupBy("shard").applyInPandas(lambda p: _merge_pairs(p, total), _PART), "pairs", "uncompressed").df
    settle(spark)
    likelihood = np.zeros(len(PRIORS))
    for row in told.where("block = -1").select("payload").toLocalIterator():
        likelihood += unpacked(row.payload)[0]
    prior = float(PRIORS[int(np.argmax(likelihood))])

    id_kind = given.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("doc_id", id_kind)])
    for name, kind in (("held_out", "boolean"), ("n_tokens", "long"), ("n_known", "long"), ("train_tokens", "long"),
                       ("base_score", "double"), ("score", "double"), ("prior", "double")):
        schema = schema.add(name, kind)

    def score(key: tuple, state: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        pairs = _Pairs(state["payload"].iloc[0], answers[~answers["of_pairs"]], begins)
        order, cut = pairs.dealt(pair_shards)
        code = np.zeros(len(pairs.v), np.uint16)
        for shard, payload in answers.loc[answers["of_pairs"], ["shard", "payload"]].itertuples(index=False):
            code[order[cut[shard]:cut[shard + 1]]] = unpacked(payload)[0]
        low = (pairs.cw + 1) / total
        smooth = np.log10((pairs.cv * _share(code) + prior * low) / (pairs.cv + prior))
        base = np.log10((pairs.count + 1) / total)
        ids = state["ids"].iloc[0]
        return pd.DataFrame({
            "doc_id": pd.Series(list(ids), dtype=object), "held_out": pairs.held, "n_tokens": pairs.sizes,
            "n_known": np.add.reduceat((pairs.count > 0).astype(np.int64), pairs.first), "train_tokens": n_train,
            "base_score": np.add.reduceat(base, pairs.first),
            "score": np.add.reduceat(smooth[pairs.pair], pairs.first), "prior": prior})

    both = known.withColumn("of_pairs", F.lit(False)).unionByName(told.where("block >= 0").withColumn("of_pairs", F.lit(True)))
    return states.groupBy("block").cogroup(both.groupBy("block")).applyInPandas(score, schema)


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, the model learnt from those whose id's checksum leaves no 2 by 7."""
    docs = table(prepared(spark), sf_dir, "documents")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    return score_documents(docs, held)
