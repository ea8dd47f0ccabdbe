"""Time arithmetic on zone-free timestamps (sessions run in UTC)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

SECOND = 1_000_000
HOUR = 3600 * SECOND
DAY = 24 * HOUR


def micros(ts: Column) -> Column:
    """Microseconds since 1970."""
    return F.unix_micros(ts.cast("timestamp"))


def bucket(ts: Column, width_hours: int) -> Column:
    """Number of the fixed-width time bucket that holds ts."""
    at, width = micros(ts), F.lit(width_hours * HOUR)
    return ((at - F.pmod(at, width)) / width).cast("long")


def plus(ts: Column, days=0, hours=0, seconds=0) -> Column:
    """ts moved by a number of days, hours and seconds; each may be a column."""

    def as_col(v):
        return v if isinstance(v, Column) else F.lit(v)

    return ts + F.make_dt_interval(as_col(days), as_col(hours), F.lit(0), as_col(seconds))


def hours_between(start: Column, end: Column) -> Column:
    """Whole hours from start to end, truncated toward zero."""
    return ((micros(end) - micros(start)) / F.lit(HOUR)).cast("long")


def days_between(start: Column, end: Column) -> Column:
    """Days from start to end as a fraction."""
    return (micros(end) - micros(start)) / F.lit(float(DAY))


def years_before(ts: Column, years: int) -> Column:
    """ts minus calendar years; 29 February becomes 28 February where the year has none."""
    return ts - F.make_ym_interval(F.lit(years))


def age_years(dob: Column, on: Column) -> Column:
    """Calendar age: whole years plus the share of the current year of life that has passed."""
    birthday = F.add_months(dob, F.year(on).cast("int") * 12 - F.year(dob).cast("int") * 12)
    whole = F.year(on) - F.year(dob) - F.when(on < birthday, 1).otherwise(0)
    last = F.add_months(dob, (whole * 12).cast("int"))
    following = F.add_months(dob, (whole * 12 + 12).cast("int"))
    return whole + F.datediff(on, last) / F.datediff(following, last)


def cyclic_hour(ts: Column) -> Column:
    """Distance of the hour from midday."""
    return F.abs(F.lit(12) - F.hour(ts))


def weekday(ts: Column) -> Column:
    """Three-letter weekday in lower case."""
    return F.lower(F.date_format(ts, "E"))


def circle_hour(ts: Column) -> Column:
    """Sum of the unit-circle coordinates of the hour."""
    return F.sin(math.pi * F.hour(ts) / 12) + F.cos(math.pi * F.hour(ts) / 12)
