"""Calendar helpers: months, day offsets and elapsed whole days."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def to_day(text: Column | str) -> Column:
    """A 'YYYY-MM-DD' text as a date; null where it is not one."""
    return _col(text).try_cast("date")


def month_start(day: Column | str) -> Column:
    return F.trunc(_col(day), "month")


def month_name(month: Column | str) -> Column:
    """English name of a month number."""
    return F.date_format(F.make_date(F.lit(2000), _col(month).cast("int"), F.lit(1)), "MMMM")


def elapsed_days(later: Column | str, earlier: Column | str) -> Column:
    """Whole 24-hour periods between two timestamps, floored.

    One hour before ``earlier`` is day -1, 23:00 to 01:00 is day 0.  The calendar
    difference is at most one too high, and it is exactly when ``earlier`` moved
    by that many days lies after ``later``.
    """
    later, earlier = _col(later), _col(earlier)
    days = F.datediff(later, earlier)
    moved = earlier + F.make_dt_interval(days)
    return days - F.when(moved > later, 1).otherwise(0)
