"""Dates, money and ratios."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---- clock -----------------------------------------------------------------------------------


def ts_lit(value: datetime) -> Column:
    return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")


def date_lit(value: date) -> Column:
    return F.lit(value.isoformat()).cast("date")


def in_ts_window(c: str | Column, as_of: datetime, days: int, offset: int = 0) -> Column:
    """`days` back from `as_of - offset days`, both ends included."""
    end = as_of - timedelta(days=offset)
    return col(c).between(ts_lit(end - timedelta(days=days)), ts_lit(end))


def in_date_window(c: str | Column, as_of: date, days: int) -> Column:
    """`as_of - days` to `as_of`, both ends included, so it covers days + 1 dates."""
    return col(c).between(date_lit(as_of - timedelta(days=days)), date_lit(as_of))


def check_range(name: str, value: int, low: int, high: int) -> int:
    if not low <= value <= high:
        raise ValueError(f"{name} must be between {low} and {high}, got {value}")
    return value


# ---- calendar --------------------------------------------------------------------------------


def month_of(c: str | Column) -> Column:
    return F.trunc(col(c), "MM")


def week_of(c: str | Column) -> Column:
    """Monday that starts the week."""
    return F.date_trunc("WEEK", col(c)).cast("date")


def sunday_week_number(c: str | Column) -> Column:
    """Week of the year counted from the first Sunday; days before it are week 0."""
    c = col(c)
    return F.floor((F.dayofyear(c) + 7 - F.dayofweek(c)) / 7).cast("long")


def whole_hours(start: str | Column, end: str | Column) -> Column:
    return F.timestamp_diff("HOUR", col(start), col(end))


def whole_minutes(start: str | Column, end: str | Column) -> Column:
    return F.timestamp_diff("MINUTE", col(start), col(end))


def months_apart(start: str | Column, end: str | Column) -> Column:
    """Whole months between two month starts."""
    s, e = col(start), col(end)
    return ((F.year(e) - F.year(s)) * 12 + F.month(e) - F.month(s)).cast("long")


# ---- numbers ---------------------------------------------------------------------------------


def dbl(c: str | Column) -> Column:
    return col(c).cast("double")


def ratio(num: str | Column, den: str | Column) -> Column:
    """num / den as doubles; null where den is null or zero."""
    return F.try_divide(dbl(num), dbl(den))


def zero_if_null(c: str | Column) -> Column:
    return F.coalesce(col(c), F.lit(0))


def sum_if(cond: Column, value: str | Column) -> Column:
    return F.sum(F.when(cond, col(value)))


def pct(part: str | Column, whole: str | Column, digits: int = 1) -> Column:
    """part / whole in percent; 0 where there is no whole."""
    return F.coalesce(F.round(ratio(part, whole) * 100, digits), F.lit(0.0))


def half_even_int(c: str | Column) -> Column:
    return F.rint(col(c)).cast("long")
