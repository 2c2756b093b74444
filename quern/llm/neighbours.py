"""Approximate nearest neighbours by permutations of pivots.

A vector stands for the order in which its nearest pivots come. In a block of index
vectors each is posted in the inverted files of its `PREFIX` nearest pivots, with its
rank there. A query goes through the files of its own pivots and adds up, per vector,
how much the two orders agree; the footrule distance of two orders (absent pivots
ranked behind the last) is a constant less twice that sum. The vectors of smallest
footrule distance, a fixed share of each block, are then ranked by the exact inner
product of the original vectors.

Largest inner products are made nearest neighbours by one more coordinate, in which an
index vector has what it lacks of the greatest length, and a query zero.

Equal vectors are searched once: any number of them may share one vector, and all
get and appear in its results. A query set against all rows is worked in cells of
bounded size, block of vectors by block of queries.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm.common import Saved, prepared, table

TOP = 20
#: Vectors the pivots are taken from: those with the smallest hashes of their ids.
PIVOTS = 512
PREFIX = 96
#: Share of each block that is ranked exactly, and the fewest vectors per neighbour wanted.
SHARE = 0.25
LEAST = 6
BLOCK = 8192
QUERY_BLOCK = 8192
RECALL_EVERY = 20


class PivotIndex:
    """The inverted files of one block. `vectors` and `pivots` have the added coordinate."""

    def __init__(self, vectors: np.ndarray, pivots: np.ndarray, prefix: int = PREFIX):
        self.pivots = pivots
        self.prefix = min(prefix, len(pivots))
        order, self.size = self.orders(vectors), len(vectors)
        flat = order.ravel()
        by = np.argsort(flat, kind="stable")
        self.start = np.searchsorted(flat[by], np.arange(len(pivots) + 1))
        self.rows, rank = np.divmod(by, self.prefix)
        self.worth = (self.prefix - rank).astype(np.int32)

    def orders(self, vectors: np.ndarray) -> np.ndarray:
        """The nearest pivots of each vector, nearest first, ties by pivot number."""
        length = np.sqrt((vectors**2).sum(axis=1, keepdims=True))
        near = (vectors / np.where(length > 0, length, 1)) @ self.pivots.T
        return np.argsort(-near, axis=1, kind="stable")[:, :self.prefix]

    def nearest(self, order: np.ndarray, n: int) -> np.ndarray:
        """The n rows of smallest footrule distance to a query's pivot order."""
        agree = np.zeros(self.size, np.int32)
        for rank, pivot in enumerate(order):
            lo, hi = self.start[pivot], self.start[pivot + 1]
            agree[self.rows[lo:hi]] += np.minimum(self.worth[lo:hi], self.prefix - rank)
        if n >= self.size:
            return np.arange(self.size)
        return np.argpartition(-agree, n - 1)[:n]


def augmented(vectors: np.ndarray, greatest: float) -> np.ndarray:
    rest = np.maximum(greatest - (vectors**2).sum(axis=1), 0)
    return np.column_stack([vectors, np.sqrt(rest)])


def search_block(
    ids: np.ndarray, vectors: np.ndarray, queries: np.ndarray, pivots: np.ndarray, greatest: float, top: int,
    share: float = SHARE, least: int = LEAST,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query number, id, score) of the best `top` found in a block, for each query."""
    index = PivotIndex(augmented(vectors, greatest), pivots)
    orders = index.orders(np.column_stack([queries, np.zeros(len(queries))]))
    n = max(least * top, int(np.ceil(share * len(ids))))
    number, found, scores = [], [], []
    for q, order in enumerate(orders):
        at = index.nearest(order, n)
        score = (vectors[at] * queries[q]).sum(axis=1)
        best = np.lexsort((ids[at], -score))[:top]
        number.append(np.full(len(best), q))
        found.append(ids[at[best]])
        scores.append(score[best])
    join = lambda parts, kind: np.concatenate([np.zeros(0, kind), *parts]).astype(kind)
    return join(number, np.int64), join(found, np.int64), join(scores, np.float64)


def _stack(vectors: pd.Series, width: int) -> np.ndarray:
    return np.array([np.asarray(v, np.float64) for v in vectors], np.float64).reshape(len(vectors), width)


def nearest(
    vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", top: int = TOP,
    pivots: int = PIVOTS, share: float = SHARE,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the `top` nearest found of each query row.

    Left out are rows without an id, vectors that are null, empty, zero or hold nulls or
    numbers that are not finite, and those of another width than most have (of equally
    common widths the larger counts). Rows that repeat both id and vector count once,
    and a query never finds its own id. Ties go to the smaller id. With `top` candidates
    or fewer in all, all are returned; without vectors there are no rows.
    """
    spark = prepared(vectors.sparkSession)
    numbers = F.col(vector_col).cast("array<double>")
    finite = ~F.exists(numbers, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    given = vectors.select(
        F.col(id_col).cast("long").alias("id"), numbers.alias("v"), finite.alias("finite"), is_query.alias("asks"))
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    given = given.where("id is not null and finite").withColumn("square", square).where("square > 0")
    widths = given.groupBy(F.size("v").alias("width")).agg(
        F.count(F.lit(1)).alias("n"), F.max("square").alias("greatest")).orderBy(F.desc("n"), F.desc("width")).limit(1)
    most = widths.collect()
    if not most:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    width, count, greatest = most[0]
    given = given.where(F.size("v") == width)

    # an equal vector's smallest ids: more could not be among the `top` besides the query
    ids = Window.partitionBy("v").orderBy("id")
    few = given.select("id", "v").withColumn("place", F.dense_rank().over(ids)).where(F.col("place") <= top + 1)
    unlike = Saved(few.groupBy("v").agg(
        F.min("id").alias("rep"), F.sort_array(F.collect_set("id")).alias("members")), "vectors").df
    asked = given.where("asks").select(F.col("id").alias("query_id"), "v").distinct()
    asked = Saved(asked.join(unlike.select("v", "rep"), "v").select("query_id", "rep"), "asked").df

    drawn = unlike.orderBy(F.xxhash64("rep"), "rep").limit(pivots).select("v").toPandas()["v"]
    around = augmented(_stack(drawn, width), greatest)
    around /= np.sqrt((around**2).sum(axis=1, keepdims=True))

    queries = unlike.join(asked.select("rep").distinct(), "rep", "left_semi").select("rep", "v")
    blocks, parts = -(-count // BLOCK), -(-asked.count() // QUERY_BLOCK) or 1

    def part(n: int) -> Column:
        return F.pmod(F.xxhash64("rep"), F.lit(n)).cast("int")

    def every(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    index = unlike.select("rep", "v", part(blocks).alias("block"), every(parts).alias("part"))
    queries = queries.select(
        F.col("rep").alias("asking"), F.col("v").alias("wanted"), part(parts).alias("part"), every(blocks).alias("block"))

    def cell(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        asking = right["asking"].to_numpy(np.int64)
        number, found, score = search_block(
            left["rep"].to_numpy(np.int64), _stack(left["v"], width), _stack(right["wanted"], width), around, greatest,
            top + 1, share)
        return pd.DataFrame({"asking": asking[number], "rep": found, "score": score})

    cells = index.groupBy("block", "part").cogroup(queries.groupBy("block", "part"))
    hits = cells.applyInPandas(cell, "asking long, rep long, score double")
    best = Window.partitionBy("asking").orderBy(F.desc("score"), "rep")
    hits = hits.withColumn("place", F.row_number().over(best)).where(F.col("place") <= top + 1)
    hits = hits.join(unlike.select("rep", "members"), "rep").groupBy("asking").agg(
        F.collect_list(F.struct("score", "members")).alias("found"))  # `top` + 1 vectors at most

    one = asked.join(hits, asked.rep == hits.asking).select(
        "query_id", F.explode("found").alias("f")).select(
        "query_id", F.col("f.score").alias("score"), F.explode("f.members").alias("vec_id")).where("vec_id != query_id")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return one.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select(
        "query_id", "rank", "vec_id", "score")


def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors found for every row whose id is divisible by 20."""
    vectors = table(prepared(spark), sf_dir, "embeddings")
    return nearest(vectors, F.col("vec_id") % RECALL_EVERY == 0)
