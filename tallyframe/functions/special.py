"""Tail probabilities for the test statistics.

They are applied to result rows only - one per test - never to data rows.
"""

from __future__ import annotations

import math
import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, functions as F

# The formulas travel to the workers by value; they need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_TINY = 1e-300
_EPS = 1e-16


def normal_cdf(z: float) -> float:
    return 0.5 * math.erfc(-z / math.sqrt(2.0))


def _beta_fraction(x: float, a: float, b: float) -> float:
    """Continued fraction of the incomplete beta function (Lentz's method)."""
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > _TINY else _TINY)
    value = d
    for m in range(1, 100_000):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        for term in (even, odd):
            d = 1.0 + term * d
            d = 1.0 / (d if abs(d) > _TINY else _TINY)
            c = 1.0 + term / c
            c = c if abs(c) > _TINY else _TINY
            value *= c * d
        if abs(c * d - 1.0) < _EPS * 4:
            break
    return value


def incomplete_beta(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function I_x(a, b)."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    log_front = (
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
        + a * math.log(x) + b * math.log1p(-x)
    )
    if x < (a + 1.0) / (a + b + 2.0):
        return math.exp(log_front) * _beta_fraction(x, a, b) / a
    return 1.0 - math.exp(log_front) * _beta_fraction(1.0 - x, b, a) / b


def student_cdf(t: float, df: float) -> float:
    tail = 0.5 * incomplete_beta(df / (df + t * t), df / 2.0, 0.5)
    return 1.0 - tail if t > 0 else tail


def f_sf(f: float, df1: float, df2: float) -> float:
    if f <= 0.0:
        return 1.0
    return incomplete_beta(df2 / (df2 + df1 * f), df2 / 2.0, df1 / 2.0)


def two_tails(cdf: float, alternative: str) -> float:
    """p-value from a cumulative probability for the chosen alternative."""
    if alternative == "smaller":
        return cdf
    if alternative == "larger":
        return 1.0 - cdf
    if alternative == "two-sided":
        return 2.0 * min(cdf, 1.0 - cdf)
    raise ValueError(f"unknown alternative: {alternative}")


def _missing(*values: float) -> bool:
    return any(v is None or math.isnan(v) for v in values)


def normal_p(z: Column, alternative: str) -> Column:
    @F.pandas_udf("double")
    def p_value(stat: pd.Series) -> pd.Series:
        return stat.map(
            lambda s: None if _missing(s) else two_tails(normal_cdf(s), alternative)
        ).astype("float64")

    return p_value(z)


def student_p(t: Column, df: Column, alternative: str) -> Column:
    @F.pandas_udf("double")
    def p_value(stat: pd.Series, dof: pd.Series) -> pd.Series:
        return pd.Series(
            [
                None if _missing(s, d) else two_tails(student_cdf(s, d), alternative)
                for s, d in zip(stat, dof)
            ],
            dtype="float64",
        )

    return p_value(t, df)


def f_p(f: Column, df1: Column, df2: Column) -> Column:
    @F.pandas_udf("double")
    def p_value(stat: pd.Series, dof1: pd.Series, dof2: pd.Series) -> pd.Series:
        return pd.Series(
            [
                None if _missing(s, a, b) else f_sf(s, a, b)
                for s, a, b in zip(stat, dof1, dof2)
            ],
            dtype="float64",
        )

    return p_value(f, df1, df2)
