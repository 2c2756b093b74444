"""Period texts of questions as ranges of days."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values: words of period texts ---------------------------------------
MONTHS = (
    "january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november",
    "december",
)
UNITS = {"month": 1, "quarter": 3, "year": 12}

_SIDE = rf"(?:q[1-4] |(?:{'|'.join(MONTHS)}) )?\d{{4}}"
_SPAN = rf"(\d{{1,3}}) ({'|'.join(UNITS)})s?"
_AGAINST = r" (?:vs\.?|versus) "
PERIOD_PATTERN = rf"\b({_SIDE}){_AGAINST}({_SIDE})\b|\blast {_SPAN}{_AGAINST}(?:prior|previous) {_SPAN}\b"


def _named(side: Column) -> tuple[Column, Column]:
    """The first day of a year, a quarter or a month by its name, and the day after."""
    year, name = F.right(side, F.lit(4)).cast("int"), F.substring_index(side, " ", 1)
    quarter = F.substring(name, 2, 1)
    at = F.array_position(F.array(*map(F.lit, MONTHS)), name).cast("int")
    month = F.when(~F.contains(side, F.lit(" ")), 1).when(at > 0, at).otherwise(quarter.cast("int") * 3 - 2)
    length = F.when(~F.contains(side, F.lit(" ")), 12).when(at > 0, 1).otherwise(3)
    start = F.make_date(year, month, F.lit(1))
    return start, F.add_months(start, length)


def period_ranges(text: Column, newest: Column) -> Column:
    """The first pair of periods a text names, as a struct of half-open ranges of days:
    `a_from`, `a_to`, `b_from`, `b_to`; null where it names none.

    Known are years, quarters and months on both sides of `vs` or `versus` ("2024 vs 2023",
    "Q1 2024 vs March 2023"), and spans of months, quarters or years up to `newest`, a day
    of the last month that counts, against the span before ("last 6 months vs prior 6
    months"). Letter case does not matter.
    """
    low = F.lower(text)
    part = lambda i: F.regexp_extract(low, PERIOD_PATTERN, i)
    units = F.create_map(*(F.lit(x) for pair in UNITS.items() for x in pair))
    months = lambda n, unit: F.when(n != "", n).cast("int") * F.try_element_at(units, unit)

    end = F.add_months(F.trunc(newest, "month"), 1)
    since = F.add_months(end, -months(part(3), part(4)))
    before = F.add_months(since, -months(part(5), part(6)))
    spans = [since, end, before, since]
    named = [*_named(part(1)), *_named(part(2))]
    names = ("a_from", "a_to", "b_from", "b_to")
    pick = [F.when(part(1) != "", n).otherwise(s).alias(name) for n, s, name in zip(named, spans, names)]
    return F.when((part(1) != "") | (part(3) != ""), F.struct(*pick))
