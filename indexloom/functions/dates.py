"""Calendar arithmetic as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def third_friday(day: Column) -> Column:
    """Third Friday of the day's month."""
    return F.date_add(F.next_day(F.date_sub(F.trunc(day, "month"), 1), "Fri"), 14)


def is_month_end(day: Column) -> Column:
    return F.last_day(day) == day


def month_starts(first: str, last: str) -> Column:
    """Array of first days of the months from ``first`` to ``last``."""
    return F.sequence(F.trunc(F.lit(first).cast("date"), "month"), F.lit(last).cast("date"), F.expr("interval 1 month"))


def business_days(first: str, last: str, holidays: list[str]) -> Column:
    """Array of weekdays between two days without the given ``MM-dd`` holidays."""
    days = F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))
    return F.filter(days, lambda d: ~F.dayofweek(d).isin(1, 7) & ~F.date_format(d, "MM-dd").isin(*holidays))


def quarter_of(day: Column) -> Column:
    """Quarter of the year, 1 to 4."""
    return F.quarter(day)
