import datetime as dt

import pytest
from pyspark.sql import functions as F

from quern.operators import spread

KINDS = ["inner", "left", "left_semi", "left_anti", "right", "full"]


@pytest.fixture(scope="module")
def sides(spark):
    left = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 3 == 1, F.lit(None)).otherwise(F.col("id")).cast("long").alias("k"),
        F.col("id").alias("row"),
    )
    right = spark.range(0, 60).select(F.col("id").alias("k"), F.concat(F.lit("v"), "id").alias("v"))
    right = right.unionByName(spark.createDataFrame([(7, "again"), (None, "null"), (99999, "alone")], "k long, v string"))
    return left, right


def same(left, right, keys, how):
    plain = left.join(right, keys, how)
    rows = sorted(map(str, plain.collect()))
    for hot in (False, True):
        spread_out = spread.spread_join(left, right, keys, how, hot_left=hot)
        assert spread_out.dtypes == plain.dtypes
        assert sorted(map(str, spread_out.collect())) == rows


@pytest.mark.parametrize("how", KINDS)
def test_same_as_plain_join(sides, how):
    same(*sides, ["k"], how)


@pytest.mark.parametrize("how", KINDS)
def test_unlike_key_types(spark, how):
    ints = spark.createDataFrame([(7,)] * 1000 + [(8,), (None,)], "k int")
    longs = spark.createDataFrame([(7, "a"), (9, "b"), (None, "c"), (1 << 40, "d")], "k long, v string")
    same(ints, longs, ["k"], how)
    same(longs, ints, ["k"], how)
    day = dt.date(2024, 5, 1)
    days = spark.createDataFrame([(day, 1)] * 50 + [(None, 2)], "k date, n int")
    times = spark.createDataFrame([(dt.datetime(2024, 5, 1), "x"), (dt.datetime(2024, 5, 1, 3), "y")], "k timestamp, v string")
    same(days, times, ["k"], how)
    same(days.where("k is null"), times, ["k"], how)


def test_two_keys(spark):
    left = spark.createDataFrame([(1, "a", i) for i in range(50)] + [(1, None, 99), (2, "b", 5)], "x int, y string, i int")
    right = spark.createDataFrame([(1, "a", "hit"), (2, "c", "no")], "x int, y string, z string")
    for how in KINDS:
        same(left, right, ["x", "y"], how)


def test_no_job_while_the_plan_is_built(spark, sides):
    spark.sparkContext.setJobGroup("building", "")
    try:
        for how in KINDS:
            spread.spread_join(*sides, ["k"], how, hot_left=True)
        spread.running_offset(sides[0], ["k"], "row", "row", "o")
        assert not spark.sparkContext.statusTracker().getJobIdsForGroup("building")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_hot_and_null_keys_land_in_many_tasks(spark):
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "8k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8k",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    left = spark.range(0, 60_000, 1, 12).select(
        F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 3 == 1, F.lit(None)).otherwise(F.col("id")).cast("long").alias("k"),
        F.sha2(F.col("id").cast("string"), 256).alias("wide"))
    right = spark.range(50_000).select(F.col("id").alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("v"))
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        joined = spread.spread_join(left, right, ["k"], "left").withColumn("task", F.spark_partition_id())
        sizes = [r["count"] for r in joined.groupBy("task").count().collect()]
        assert sum(sizes) == 60_000 and max(sizes) < 15_000
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


@pytest.mark.parametrize("bits", [1, 3, 21])
@pytest.mark.parametrize("step", [1, 1000])
def test_running_offset(spark, bits, step):
    rows = [("a", i * i * step, i % 3) for i in range(40)] + [("b", 5, 2)] + [(None, i, 1) for i in range(9)]
    df = spark.createDataFrame(rows, "g string, p int, n int").repartition(5)
    got = {(r["g"], r["p"]): r["o"] for r in spread.running_offset(df, ["g"], "p", "n", "o", bits).collect()}
    totals, expected = {}, {}
    for g, p, n in rows:
        expected[(g, p)] = totals.get(g, 0)
        totals[g] = totals.get(g, 0) + n
    assert got == expected
