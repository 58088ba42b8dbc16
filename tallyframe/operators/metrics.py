"""Ratios and shares of aggregated results, activity spans, retention."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from tallyframe.functions.numeric import half_up, known, quotient, total
from tallyframe.operators.joins import cohort_activity


def with_ratio(df: DataFrame, numerator: str, denominator: str, out: str, scale: int = 2) -> DataFrame:
    """Rounded quotient of two columns, kept as a decimal so that it sums exactly.

    Measured values are divided as decimals with eighteen places and rounded
    once; values that do not fit are divided as doubles.
    """
    top, bottom = (F.col(c).try_cast("decimal(20,6)") for c in (numerator, denominator))
    rounded = F.coalesce(
        half_up(F.try_divide(top, bottom), scale), half_up(quotient(numerator, denominator), scale)
    )
    return df.withColumn(out, rounded.cast(f"decimal(18,{scale})"))


def share_of_total(df: DataFrame, column: str, out: str, scale: int = 2) -> DataFrame:
    """Percent of the column's grand total, taken from a scalar subquery."""
    everything = df.agg(F.sum(column)).scalar()
    return df.withColumn(out, half_up(quotient(F.col(column) * 100, everything), scale))


def share_within(df: DataFrame, by: Sequence[str], column: str, out: str, scale: int = 2) -> DataFrame:
    """Percent of the column's total inside a group of an aggregated result."""
    group_sum = F.sum(column).over(Window.partitionBy(*by))
    return df.withColumn(out, half_up(quotient(F.col(column) * 100, group_sum), scale))


def ratio_to_max(df: DataFrame, column: str, out: str, scale: int = 2) -> DataFrame:
    """Ratio to the column's maximum, taken from a scalar subquery."""
    largest = df.agg(F.max(column)).scalar()
    return df.withColumn(out, half_up(quotient(column, largest), scale))


def entity_span(df: DataFrame, key: Sequence[str], day: str, out: str, count: str) -> DataFrame:
    """Days between the first and the last date of an entity, and its row count."""
    return df.groupBy(*key).agg(
        F.datediff(F.max(day), F.min(day)).alias(out), F.count("*").alias(count)
    )


def retention(df: DataFrame, user: str, day: str, base_day) -> DataFrame:
    """Users of the base day seen again per day offset, and their rate."""
    pairs = cohort_activity(df, user, day, base_day, "day_since_install")
    per_day = pairs.groupBy("day_since_install").agg(F.count("*").alias("retained_users"))
    return ratio_to_max(per_day, "retained_users", "retention_rate")


def group_means_with_total(
    df: DataFrame, key: str, value: str, out: str, total_out: str
) -> DataFrame:
    """Mean per non-missing group next to the mean over all rows.

    The overall mean comes from the sums of the groups, so rows are read once.
    """
    sums = df.groupBy(key).agg(
        total(value).alias("s"), F.count(known(value)).alias("n")
    )
    overall = sums.agg(quotient(total("s"), F.sum("n"))).scalar()
    return sums.where(F.col(key).isNotNull()).select(
        key, quotient("s", "n").alias(out), overall.alias(total_out)
    )
