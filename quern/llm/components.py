"""Connected components of a graph of any size, in rounds of joins.

Alternating stars: each round hangs the larger neighbours of a node, then the
smaller ones, below the smallest node it sees. Paths shorten to half their length
or less, so a component of diameter d needs about log2(d) rounds. Per node only a
minimum is gathered, which Spark sums up before the shuffle; a node with very many
links is never held in one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from quern.llm.common import Saved


def _hang(edges: DataFrame) -> DataFrame:
    """Each `a` with its neighbours `b`: all of them below the smallest one seen."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    return edges.join(least, "a").select("a", "b", F.least("a", "m").alias("m"))


def _large(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return _hang(both).where("b > a and b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Edges run from the larger node `a` to the smaller `b` here."""
    hung = _hang(edges)
    lower = hung.where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    own = hung.select("a", F.col("m").alias("b"))
    return lower.unionByName(own).where("a != b").distinct()


def components(links: DataFrame) -> DataFrame:
    """`links` (a, b of one orderable type) to (node, root): the smallest node reachable.

    Nodes without a link to another node are not listed; nulls and links of a node to
    itself are left out; no links give no rows. Each round is written to the shared
    folder, and the round before it is removed.
    """
    edges = links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    step, before = Saved(edges, "links"), None
    while True:
        seen = Observation()
        turned = _small(_large(step.df)).observe(
            seen, F.count(F.lit(1)).alias("n"),
            F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0)).alias("sum"),
        )
        after = Saved(turned, "links")
        step.drop()
        step, now = after, (seen.get["n"], seen.get["sum"])
        if now == before or not now[0]:
            return step.df.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = now
