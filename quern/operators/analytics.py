"""The analytic query shapes: filters, joins, aggregates, trends, comparisons."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.periods import period_ranges
from quern.operators.spread import spread_join


def filter_project(df: DataFrame, where: Column, cols: Sequence[str | Column]) -> DataFrame:
    return df.where(where).select(*cols)


def join_on(
    left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner", hot_left: bool = False
) -> DataFrame:
    """Equi-join; `hot_left` for a right or full one whose left side a few keys dominate."""
    return spread_join(left, right, keys, how, hot_left)


def agg_basic(df: DataFrame, by: Sequence[str | Column], measures: Mapping[str, Column]) -> DataFrame:
    return df.groupBy(*by).agg(*[m.alias(name) for name, m in measures.items()])


def top_k(
    df: DataFrame, by: str, measure: Column, k: int = 10, where: Column | None = None
) -> DataFrame:
    """The `k` groups with the largest `total`; ties go to the smaller key."""
    rows = df if where is None else df.where(where)
    return (
        rows.groupBy(by).agg(measure.alias("total")).orderBy(F.desc("total"), F.asc(by)).limit(k)
    )


def on_day(ts: str, day: dt.date) -> Column:
    """`CAST(ts AS DATE) = day`, as a range that the file scan can use."""
    return between_days(ts, day, day + dt.timedelta(days=1))


def in_year(ts: str, year: int) -> Column:
    """`YEAR(ts) = year`, as a range that the file scan can use."""
    return between_days(ts, dt.date(year, 1, 1), dt.date(year + 1, 1, 1))


def between_days(ts: str, start: dt.date, end: dt.date) -> Column:
    stamp = lambda d: F.lit(d.isoformat()).cast("timestamp_ntz")
    return (F.col(ts) >= stamp(start)) & (F.col(ts) < stamp(end))


def bucket(ts: str | Column, grain: str) -> Column:
    """The start of the time bucket, as DATE."""
    return F.date_trunc(grain, ts).cast("date")


def trend(
    df: DataFrame, ts: str, grain: str, measure: Mapping[str, Column], by: Sequence[str] = ()
) -> DataFrame:
    return agg_basic(df, [*by, bucket(ts, grain).alias(grain)], measure)


def trend_join(left: DataFrame, right: DataFrame, by: Sequence[str], grain: str) -> DataFrame:
    """Two trends side by side. Both are aggregates already, one row per key."""
    return left.join(right, [*by, grain], "inner")


def period_compare(
    df: DataFrame, ts: str, by: Sequence[str], measure: Column, period_a: int, period_b: int
) -> DataFrame:
    """Sums of two years, their difference and the change in percent of `period_b`."""
    rows = df.where(in_year(ts, period_a) | in_year(ts, period_b))
    value = lambda y: F.coalesce(
        F.sum(F.when(in_year(ts, y), measure)), F.lit(0)
    )
    sums = rows.groupBy(*by).agg(
        value(period_a).alias("value_a"), value(period_b).alias("value_b")
    )
    return with_change(sums, "value_a", "value_b")


def with_change(df: DataFrame, a: str, b: str) -> DataFrame:
    """Adds `difference` and `percent`, null against a zero base."""
    ratio = F.try_divide((F.col(a) - F.col(b)).cast("double") * 100.0, F.col(b).cast("double"))
    return df.withColumn("difference", F.col(a) - F.col(b)).withColumn("percent", F.round(ratio, 2))


def rolling_compare(
    df: DataFrame, ts: str, by: Sequence[str], measure: Column, months: int = 6
) -> DataFrame:
    """The last `months` months against those before, up to the newest month in the data.

    The newest time is a scalar subquery, and the spans are bounds on the time column
    itself, so the scan can skip what is older than both.
    """
    time = F.col(ts)
    newest = F.date_trunc("month", df.select(F.max(time)).scalar())
    since = lambda back: F.add_months(newest, 1 - back).cast(df.schema[ts].dataType)
    recent = time >= since(months)
    total = lambda cond: F.coalesce(F.sum(F.when(cond, measure)), F.lit(0))
    rows = df.where(time >= since(2 * months))
    sums = rows.groupBy(*by).agg(
        total(recent).alias("recent_value"), total(~recent).alias("prior_value")
    )
    return with_change(sums, "recent_value", "prior_value")


def compare_periods(
    questions: DataFrame, df: DataFrame, ts: str, measure: Column, id_col: str = "question_id", text_col: str = "user_query"
) -> DataFrame:
    """The two periods each question names (`period_ranges`), and what `measure` sums up
    to in them: (id, a_from, a_to, b_from, b_to, value_a, value_b, difference, percent).
    Questions that name none are left out; a period without rows has the value 0.

    The rows are summed per month once, for all questions. A range of days begins and
    ends with a month, so ranges meet the months by equality, each range once however
    many questions name it.
    """
    newest = df.select(F.max(ts)).scalar().cast("date")
    asked = questions.select(id_col, period_ranges(F.col(text_col), newest).alias("_p")).where("_p is not null")
    asked = asked.select(id_col, "_p.*")
    monthly = trend(df.where(F.col(ts).isNotNull()), ts, "month", {"_sum": F.sum(measure)})

    sides = F.array(*(F.struct(F.col(f"{x}_from").alias("_from"), F.col(f"{x}_to").alias("_to")) for x in "ab"))
    ranges = asked.select(F.explode(sides).alias("_r")).select("_r.*").distinct()
    each = F.explode(F.expr("sequence(_from, add_months(_to, -1), interval 1 month)"))
    spread = ranges.where("_from < _to").select("_from", "_to", each.alias("month"))
    sums = spread.join(monthly, "month").groupBy("_from", "_to").agg(F.sum("_sum").alias("_value"))

    for x in "ab":
        side = sums.select(
            F.col("_from").alias(f"{x}_from"), F.col("_to").alias(f"{x}_to"), F.col("_value").alias(f"value_{x}"))
        asked = asked.join(side, [f"{x}_from", f"{x}_to"], "left")
    value = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    out = asked.select(id_col, "a_from", "a_to", "b_from", "b_to", value("value_a"), value("value_b"))
    return with_change(out, "value_a", "value_b")


def drill_down(df: DataFrame, targets: Sequence[str] | DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows that hold a target value in any of `cols`.

    A short list becomes a filter of the scan. A frame of targets (column
    `target`) is looked up once per column; a row is kept once.
    """
    if not isinstance(targets, DataFrame):
        wanted = F.lit(False)
        for c in cols:
            wanted = wanted | F.col(c).isin(list(targets))
        return df.where(wanted)
    values = targets.select("target").where("target is not null").distinct()
    marked, wanted = df, F.lit(False)
    for i, c in enumerate(cols):
        side = values.select(F.col("target").alias(f"_target{i}"))
        marked = marked.join(side, F.col(f"`{c}`") == F.col(f"_target{i}"), "left")
        wanted = wanted | F.col(f"_target{i}").isNotNull()
    return marked.where(wanted).select(*df.columns)
