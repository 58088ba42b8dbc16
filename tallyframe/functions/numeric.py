"""Exact sums, safe quotients and the two rounding rules.

Money and measures are summed as decimals so that a result does not depend on
the order in which executors deliver their partial sums; doubles that a decimal
does not hold are summed as doubles.  Not-a-number counts as missing.  Quotients
are doubles and are rounded once, on their printed digits.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

PRINTED_TYPE = "decimal(38,15)"
EXACT_TYPE = "decimal(28,10)"


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def exact(value: Column | str) -> Column:
    """The value as a fixed-point number that sums without rounding error.

    Ten decimals keep measured quantities as well as money; sums reach 10^28.
    """
    return _col(value).cast(EXACT_TYPE)


def known(value: Column | str) -> Column:
    """The value, with not-a-number as null."""
    return F.when(~F.isnan(_col(value).cast("double")), _col(value))


def total(value: Column | str) -> Column:
    """Sum over the known values, as a double.

    Independent of the order of rows if ten decimals hold every value exactly,
    as they do for money and measures; other values are summed as doubles.
    """
    x = known(value)
    fixed = x.try_cast(EXACT_TYPE)
    held = F.bool_and(fixed.cast("double").eqNullSafe(x.cast("double")))
    return F.when(held, F.try_sum(fixed).cast("double")).otherwise(F.sum(x.cast("double")))


def mean(value: Column | str) -> Column:
    """Average over the known values, as a double; the same rule as ``total``."""
    return quotient(total(value), F.count(known(value)))


def quotient(numerator: Column | str, denominator: Column | str) -> Column:
    """Division in doubles; null instead of an error for a zero divisor."""
    return F.try_divide(_col(numerator).cast("double"), _col(denominator).cast("double"))


def half_up(value: Column | str, scale: int = 2) -> Column:
    """Round half away from zero, the rule of SQL numerics.

    The first fifteen decimals of the printed value decide; only values beyond
    10^23 are rounded as doubles.
    """
    printed = _col(value).try_cast(PRINTED_TYPE)
    return F.coalesce(F.round(printed, scale).cast("double"), F.round(_col(value), scale).cast("double"))


def half_even(value: Column | str, scale: int = 2) -> Column:
    """Round half to even, the rule of the notebook studies."""
    printed = _col(value).try_cast(PRINTED_TYPE)
    return F.coalesce(F.bround(printed, scale).cast("double"), F.bround(_col(value), scale).cast("double"))


def percent(numerator: Column | str, denominator: Column | str, scale: int = 2) -> Column:
    """Share of two aggregates in percent, rounded half away from zero."""
    return half_up(quotient(_col(numerator) * 100, denominator), scale)


def within_or_null(
    value: Column | str, low: Column | None = None, high: Column | None = None
) -> Column:
    """Strictly between the bounds, or missing."""
    value = _col(value)
    inside = F.lit(True)
    if low is not None:
        inside = inside & (value > low)
    if high is not None:
        inside = inside & (value < high)
    return inside | value.isNull()
