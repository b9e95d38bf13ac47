"""Periods and dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_FORMATS = {"year": "yyyy", "month": "MMM yyyy", "day": "dd MMM yyyy", "hour": "dd MMM HH:00"}


def period_label(moment: Column, period: str) -> Column:
    """Q1 2024, Jan 2024, 01 Jan 2024 or 01 Jan 05:00."""
    if period == "quarter":
        return F.concat(F.lit("Q"), F.quarter(moment).cast("string"), F.lit(" "), F.year(moment).cast("string"))
    return F.date_format(moment, _FORMATS[period])


def datediff(start: Column, end: Column, part: str) -> Column:
    """How many boundaries of the part lie between two moments (negative backwards)."""
    part = part.lower()
    months = lambda m: F.year(m) * 12 + F.month(m)
    if part == "year":
        return (F.year(end) - F.year(start)).cast("long")
    if part == "quarter":
        return ((F.year(end) * 4 + F.quarter(end)) - (F.year(start) * 4 + F.quarter(start))).cast("long")
    if part == "month":
        return (months(end) - months(start)).cast("long")
    if part == "week":
        return F.floor(F.datediff(F.date_trunc("week", end), F.date_trunc("week", start)) / 7).cast("long")
    if part == "day":
        return F.datediff(end, start).cast("long")
    size = {"hour": 3600, "minute": 60, "second": 1}[part]
    cut = lambda m: F.unix_timestamp(F.date_trunc(part, m))
    return ((cut(end) - cut(start)) / size).cast("long")


def today() -> Column:
    """The date on which the query runs, in the session's zone."""
    return F.current_date()
