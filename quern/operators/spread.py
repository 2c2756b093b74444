"""Joins and running totals that hold up when one key owns much of the data.

Nothing here looks at the data while a plan is being built.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Positions per block of a running total, and blocks per block of blocks: as powers of
# two. Three levels of 21 bits hold every position of 63 bits.
LEVEL_BITS = 21


def spread_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], how: str, hot_left: bool = False
) -> DataFrame:
    """Equi-join whose left side may be dominated by a few keys, or by null keys.

    Inner, left, left_semi and left_anti joins are plain ones: the adaptive skew join
    cuts the left side's large partitions, those of null keys too. It cannot do so for
    right and full joins, as every cut would find the same right rows unmatched. For
    these say `hot_left` where a left key may own much of the data: they become the inner
    or left join and, apart, the right rows whose key the left side lacks, which reads
    both sides twice. Columns, types and rows are those of the plain join.
    """
    keys = list(keys)
    plain = left.join(right, keys, how)
    if how not in ("right", "full") or not hot_left:
        return plain
    matched = left.join(right, keys, "inner" if how == "right" else "left")
    only_right = right.join(left.select(*keys).distinct(), keys, "left_anti")
    both = matched.unionByName(only_right, allowMissingColumns=True)
    return both.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in plain.schema))


def running_offset(
    df: DataFrame, group: Sequence[str], position: str, amount: str, out: str, bits: int = LEVEL_BITS
) -> DataFrame:
    """Adds `out`: the sum of `amount` over the earlier positions of the group.

    `position` is an integer that orders the group. Totals run within blocks of
    2 ** `bits` positions, over the blocks within blocks of as many blocks, and over
    those: whatever the size of a group and however sparse its positions, no window
    holds more than 2 ** `bits` of them, or of blocks.
    """
    group, place = list(group), F.col(position).cast("bigint")
    amounts = F.col(amount).cast("bigint")
    before = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    earlier = lambda total, window: F.coalesce(F.sum(total).over(window), F.lit(0)).cast("bigint")

    marked = df.withColumn("_block", F.shiftright(place, bits))
    inner = marked.withColumn(out, earlier(amounts, before(*group, "_block").orderBy(position)))
    blocks = marked.groupBy(*group, "_block").agg(F.sum(amounts).alias("_total"))
    blocks = blocks.withColumn("_outer", F.shiftright("_block", bits))
    outer = blocks.groupBy(*group, "_outer").agg(F.sum("_total").alias("_all"))
    outer = outer.withColumn("_begin", earlier("_all", before(*group).orderBy("_outer")))
    starts = blocks.withColumn("_start", earlier("_total", before(*group, "_outer").orderBy("_block")))

    def same(a: DataFrame, b: DataFrame, *cols: str):
        return reduce(lambda x, y: x & y, (a[c].eqNullSafe(b[f"_{c}"]) for c in cols))

    def renamed(side: DataFrame, *cols: str) -> DataFrame:
        return side.select(*(F.col(c).alias(f"_{c}") for c in cols), F.col(side.columns[-1]))

    begins = renamed(outer, *group, "_outer")
    starts = starts.join(begins, same(starts, begins, *group, "_outer"), "left").select(
        *(starts[c] for c in group), starts["_block"], (F.col("_start") + F.col("_begin")).alias("_start"))
    starts = renamed(starts, *group, "_block")
    return inner.join(starts, same(inner, starts, *group, "_block"), "left").select(
        *(inner[c] for c in df.columns), (F.col("_start") + F.col(out)).cast("bigint").alias(out))
