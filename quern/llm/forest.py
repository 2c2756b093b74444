"""Near-duplicate vectors through a forest of random-projection trees.

A tree halves the vectors of a node at the median of their projections on a random
direction, and does so again with the halves, until a node is small. What lies within a
margin of the median goes to both sides (spill), so most near pairs stay together; the
few a tree parts are together in another of the trees. Within a leaf all vectors are
compared, and pairs at the threshold or above are links.

Nodes are split from a bounded sample of their own vectors, several levels at a time: a
round fits a small subtree for each node that is too large, in a task of its own, and
lets all its vectors down. Rounds follow until no node is too large, so their number
grows with the logarithm of the vectors. A node that directions no longer part (a crowd
of near copies) is a leaf, however large: leaves are compared block by block in cells of
bounded size.

No pair leaves a task. A pair that shares several leaves counts in the first of these
only. A task returns how many links each of its vectors has there and one link fewer
than the vectors it found connected; sums and components are Spark's. Equal vectors are
one vector that counts as many.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.common import Saved, prepared, table
from quern.llm.components import components

SIMILARITY = 0.95
TREES = 6
#: Vectors up to which a node is a leaf; vectors of a block of a larger leaf.
LEAF = 512
#: Vectors a subtree is fitted on, at most about, the fewest a split is, and its levels.
SAMPLE, LEAST, LEVELS = 8192, 32, 10
#: Vectors of a node that are let down in one task.
PART = 1 << 14
#: Directions tried per split: that with the fewest vectors near the median is taken.
DIRECTIONS = 8
#: Spill margin, in standard deviations of the projected distance of a pair at the threshold.
MARGIN = 0.5
#: A split that leaves this share or more on one side is not made.
CROWD = 0.75
SEED = 12


def unit(vectors: np.ndarray) -> np.ndarray:
    """Of length one, whatever their size: the largest number is made one first."""
    v = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return v / np.sqrt((v**2).sum(axis=1, keepdims=True))


def margin(similarity: float, width: int) -> float:
    return MARGIN * np.sqrt((2 - 2 * similarity) / width)


def directions(node: int, split: int, width: int) -> np.ndarray:
    """The directions tried at a split of a node's subtree; they follow from its number."""
    random = np.random.default_rng([SEED, node % (1 << 64), split])
    d = random.standard_normal((DIRECTIONS, width))
    return d / np.sqrt((d**2).sum(axis=1, keepdims=True))


#: Per split, numbered as in a heap from 1: the direction taken, and the threshold. A
#: split that is not made has direction -1 if its node may be split later, else -2.
Subtree = tuple[np.ndarray, np.ndarray]


def fitted(node: int, sample: np.ndarray, size: int, spill: float, leaf: int) -> Subtree:
    """A subtree for a node of `size` vectors, of which `sample` are some."""
    taken, at = np.full(1 << LEVELS, -2, np.int8), np.zeros(1 << LEVELS)
    scale = size / max(1, len(sample))
    todo = [(1, sample)]
    while todo:
        split, rows = todo.pop()
        if split >= 1 << LEVELS or len(rows) * scale <= leaf:
            continue
        if len(rows) < LEAST and scale > 1:
            taken[split] = -1
            continue
        along = rows @ directions(node, split, rows.shape[1]).T
        middle = np.median(along, axis=0)
        left, right = along < middle + spill, along >= middle - spill
        most = np.maximum(left.sum(axis=0), right.sum(axis=0))
        best = int(np.argmin(most))
        if most[best] >= CROWD * len(rows):
            continue
        taken[split], at[split] = best, middle[best]
        todo += [(2 * split, rows[left[:, best]]), (2 * split + 1, rows[right[:, best]])]
    return taken, at


def later(subtree: Subtree, split: np.ndarray) -> np.ndarray:
    """Which ends of a subtree may be split in a later round."""
    return (split >= len(subtree[0])) | (subtree[0][np.minimum(split, len(subtree[0]) - 1)] == -1)


def let_down(node: int, vectors: np.ndarray, subtree: Subtree, spill: float) -> tuple[np.ndarray, np.ndarray]:
    """(vector number, split number where it ends), several for a vector that spills."""
    taken, at = subtree
    out, todo = [], [(1, np.arange(len(vectors)))]
    while todo:
        split, rows = todo.pop()
        if split >= len(taken) or taken[split] < 0 or not len(rows):
            out.append((rows, np.full(len(rows), split)))
            continue
        along = vectors[rows] @ directions(node, split, vectors.shape[1])[taken[split]]
        todo += [(2 * split, rows[along < at[split] + spill]), (2 * split + 1, rows[along >= at[split] - spill])]
    return tuple(np.concatenate(x) for x in zip(*out))


def _stack(vectors: pd.Series, kind: type = np.float64) -> np.ndarray:
    return np.frombuffer(b"".join(vectors), kind).reshape(len(vectors), -1)


@F.pandas_udf(T.BinaryType())
def _brief(units: pd.Series) -> pd.Series:
    return pd.Series([np.frombuffer(u).astype(np.float32).tobytes() for u in units], dtype=object)


def _child(node: np.ndarray | int, split: np.ndarray) -> np.ndarray:
    """The number of a node's descendant: a mix of both, as numbers grow with the depth."""
    x = (np.uint64(node) ^ (split.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(32))).view(np.int64)


def _round(posts: DataFrame, vectors: DataFrame, sizes: DataFrame, similarity: float, leaf: int) -> DataFrame:
    """Posts (cid, node) of too large nodes, with their `sizes` (node, n), a subtree further
    down: (cid, node, open). A node is let down in parts of bounded size."""
    sized = posts.join(sizes, "node")
    drawn = sized.where(F.pmod(F.xxhash64("cid", "node"), F.lit(1 << 30)) * F.col("n") < F.lit(SAMPLE << 30))

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        node, sample = int(rows["node"].iloc[0]), _stack(rows.sort_values("cid")["brief"], np.float32)
        subtree = fitted(node % (1 << 64), sample, int(rows["n"].iloc[0]), margin(similarity, sample.shape[1]), leaf)
        return pd.DataFrame({"node": [node], "taken": [subtree[0].tobytes()], "at": [subtree[1].tobytes()]})

    fits = Saved(drawn.join(vectors, "cid").select("node", "n", "cid", "brief").groupBy("node").applyInPandas(
        fit, "node long, taken binary, at binary"), "subtrees").df

    def down(rows: pd.DataFrame, fit: pd.DataFrame) -> pd.DataFrame:
        if rows.empty:
            return pd.DataFrame({"cid": [], "node": [], "open": []}).astype({"cid": "int64", "node": "int64", "open": bool})
        node, v = int(rows["node"].iloc[0]) % (1 << 64), _stack(rows["brief"], np.float32)
        subtree = np.frombuffer(fit["taken"].iloc[0], np.int8), np.frombuffer(fit["at"].iloc[0], np.float64)
        of, split = let_down(node, v, subtree, margin(similarity, v.shape[1]))
        return pd.DataFrame({"cid": rows["cid"].to_numpy()[of], "node": _child(node, split), "open": later(subtree, split)})

    parts = F.ceil(F.col("n") / PART).cast("int")
    rows = sized.join(vectors, "cid").select("cid", "node", "brief", F.pmod(F.xxhash64("cid"), parts).cast("int").alias("part"))
    fits = fits.join(sizes, "node").select("node", "taken", "at", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    return rows.groupBy("node", "part").cogroup(fits.groupBy("node", "part")).applyInPandas(
        down, "cid long, node long, open boolean")


def leaves(vectors: DataFrame, similarity: float, trees: int = TREES, leaf: int = LEAF) -> DataFrame:
    """(cid, leaf) for `vectors` (cid, and `brief` in single precision): each in one leaf
    or more of each tree. Vectors of unlike width have trees of their own."""
    width = F.length("brief")
    posts = vectors.select("cid", F.explode(F.sequence(F.lit(1), F.lit(trees))).alias("tree"), width.alias("w")).select(
        "cid", F.xxhash64("tree", "w").alias("node"), F.lit(True).alias("open"))
    done = None
    while True:
        step = Saved(posts, "posts").df
        sizes = step.where("open").groupBy("node").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > leaf)
        sizes = Saved(sizes, "nodes").df
        ready = step.join(sizes, "node", "left_anti").select("cid", F.col("node").alias("leaf"))
        done = ready if done is None else done.unionByName(ready)
        if sizes.isEmpty():
            return done
        posts = _round(step.join(sizes, "node", "left_semi").select("cid", "node"), vectors, sizes, similarity, leaf)


def connected(near: np.ndarray) -> np.ndarray:
    """Of a symmetric matrix of links, the smallest member each is connected to."""
    label = np.arange(len(near))
    for _ in range(len(near)):
        least = np.minimum(np.where(near, label[None, :], len(near)).min(axis=1, initial=len(near)), label)
        least = least[least]
        if (least == label).all():
            break
        label = least
    return label


def _first_here(one: list[np.ndarray], other: list[np.ndarray], leaf: int) -> np.ndarray:
    """Which of the pairs have this leaf as the first (smallest) they share."""
    early = [[x[x < leaf] for x in side] for side in (one, other)]
    known, place = np.unique(np.concatenate([np.zeros(0, np.int64), *early[0], *early[1]]), return_inverse=True)
    inside, at = [], 0
    for side in early:
        sizes = [len(x) for x in side]
        marks = np.zeros((len(side), len(known)), np.float32)
        marks[np.repeat(np.arange(len(side)), sizes), place[at:at + sum(sizes)]] = 1
        inside.append(marks)
        at += sum(sizes)
    return inside[0] @ inside[1].T == 0


def _cell(rows: pd.DataFrame, similarity: float) -> pd.DataFrame:
    """Links within a leaf's block, or between two: per vector how many others it has
    here, equal ones counted, and one it is connected to."""
    leaf, lo, hi = (int(rows[c].iloc[0]) for c in ("leaf", "lo", "hi"))
    rows = rows.sort_values(["block", "cid"], ignore_index=True)
    sides = [rows[rows["block"] == b] for b in sorted({lo, hi})]
    if len(sides) == 2 and not (len(sides[0]) and len(sides[1])):
        return pd.DataFrame({"cid": [], "n_links": [], "other": []}, dtype="int64")
    one, other = sides[0], sides[-1]
    u, v = _stack(one["unit"]), _stack(other["unit"])
    fresh = _first_here(one["leaves"].to_list(), other["leaves"].to_list(), leaf)
    near = (u @ v.T >= similarity) & fresh
    if lo == hi:
        np.fill_diagonal(near, False)
        near = near | near.T
        whole, n = near, near @ one["copies"].to_numpy(np.int64)
    else:
        whole = np.zeros((len(rows), len(rows)), bool)
        whole[:len(one), len(one):], whole[len(one):, :len(one)] = near, near.T
        n = np.concatenate([near @ other["copies"].to_numpy(np.int64), one["copies"].to_numpy(np.int64) @ near])
    cid = rows["cid"].to_numpy(np.int64)
    found = np.flatnonzero(n)
    return pd.DataFrame({"cid": cid[found], "n_links": n[found], "other": cid[connected(whole)[found]]})


def links(classes: DataFrame, similarity: float, trees: int = TREES, leaf: int = LEAF) -> DataFrame:
    """(cid, n_links, other) by cell for `classes` (cid, unit, copies): the parts of each
    vector's number of links, and edges that connect what links connect."""
    brief = _brief("unit")
    vectors = Saved(classes.select("cid", brief.alias("brief")), "brief").df
    posts = Saved(leaves(vectors, similarity, trees, leaf).distinct(), "leaves").df
    sizes = posts.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(
        "leaf", F.ceil(F.col("n") / leaf).cast("int").alias("blocks"))
    shared = Saved(posts.join(sizes, "leaf"), "leaves").df
    own = shared.groupBy("cid").agg(F.sort_array(F.collect_list("leaf")).alias("leaves"))  # a few a tree
    block = F.pmod(F.xxhash64("cid", "leaf"), F.col("blocks")).cast("int").alias("block")
    cells = shared.select("cid", "leaf", "blocks", block).select(
        "cid", "leaf", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).select(
        "cid", "leaf", "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))
    members = Saved(classes.join(own, "cid"), "members").df
    return cells.join(members, "cid").groupBy("leaf", "lo", "hi").applyInPandas(
        lambda rows: _cell(rows, similarity), "cid long, n_links long, other long")


def near_duplicates(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", similarity: float = SIMILARITY,
    trees: int = TREES, leaf: int = LEAF,
) -> DataFrame:
    """(id, n_links, component_id, kept), one row per row of `vectors`.

    Rows are linked if the cosine of their vectors, in double precision, is `similarity`
    or more and the vectors have the same width. Vectors that are null, empty, zero or
    hold nulls or numbers that are not finite have no links. Equal rows are linked with
    one another like others, and each is answered. A component's id is the smallest of
    its ids; null ids take part, and what has no other id has a null one. Kept is what
    bears its component's id. No rows give no rows; other columns are not looked at.
    """
    prepared(vectors.sparkSession)
    numbers = F.col(vector_col).cast("array<double>")
    given = vectors.select(
        F.col(id_col).alias("id"), numbers.alias("v"), F.monotonically_increasing_id().alias("row"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    sound = F.coalesce(~bad & F.exists("v", lambda x: x != 0), F.lit(False))
    given = Saved(given.withColumn("v", F.when(sound, F.col("v"))), "given").df

    @F.pandas_udf(T.BinaryType())
    def units(v: pd.Series) -> pd.Series:
        return pd.Series([unit(np.asarray(x, np.float64)[None, :])[0].tobytes() for x in v], dtype=object)

    unlike = given.where("v is not null").groupBy("v").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("copies"))
    classes = Saved(unlike.withColumn("cid", F.monotonically_increasing_id()).withColumn("unit", units("v")), "classes").df

    found = Saved(links(classes.select("cid", "unit", "copies"), similarity, trees, leaf), "found").df
    direct = found.groupBy("cid").agg(F.sum("n_links").alias("n"))
    roots = components(found.select(F.col("cid").alias("a"), F.col("other").alias("b")))
    named = classes.select("v", "cid", "least", "copies").join(direct, "cid", "left").join(
        roots, F.col("cid") == F.col("node"), "left").withColumn("root", F.coalesce("root", "cid"))
    named = Saved(named.select("v", "least", "root", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "named").df
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(ids, "root").select("v", "n_links", "component_id", F.lit(True).alias("sound"))
    out = given.join(named, "v", "left").select(
        F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("sound"), F.col("component_id")).otherwise(F.col("id")).alias("component_id"))
    return out.withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))


def op12_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's links at a cosine of 0.95 or more, and its component."""
    return near_duplicates(table(prepared(spark), sf_dir, "embeddings"))
