"""Experiment checks: group sizes, overlap, lifetime window, conversion, power."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, functions as F

from tallyframe.functions.numeric import half_even, quotient
from tallyframe.functions.temporal import elapsed_days
from tallyframe.operators.joins import with_first_event


def group_sizes(df: DataFrame, group: str, user: str, out: str = "users") -> DataFrame:
    """Distinct users per group."""
    return df.groupBy(group).agg(F.count_distinct(user).alias(out))


def group_shares(df: DataFrame, group: str, user: str) -> DataFrame:
    """Distinct users per group and their percent of the sum over groups."""
    sizes = group_sizes(df, group, user)
    everyone = sizes.agg(F.sum("users")).scalar()
    return sizes.withColumn("share", quotient(F.col("users") * 100, everyone))


def group_imbalance(df: DataFrame, group: str, user: str, control, test) -> DataFrame:
    """Difference of two group sizes in percent of the control group; one row."""
    return compare_groups(group_sizes(df, group, user), group, "users", control, test).select(
        "control_users", "test_users",
        (quotient(F.abs(F.col("control_users") - F.col("test_users")), "control_users")
         * 100).alias("imbalance"),
    )


def compare_groups(sizes: DataFrame, group: str, value: str, control, test) -> DataFrame:
    """The values of two named groups side by side; never by row position."""
    return sizes.agg(
        F.max(F.when(F.col(group) == F.lit(control), F.col(value))).alias(f"control_{value}"),
        F.max(F.when(F.col(group) == F.lit(test), F.col(value))).alias(f"test_{value}"),
    )


def duration_days(df: DataFrame, clock: str) -> DataFrame:
    """Whole days between the first and the last event; one row."""
    return df.agg(F.min(clock).alias("first"), F.max(clock).alias("last")).select(
        elapsed_days("last", "first").alias("duration_days")
    )


def within_lifetime(
    df: DataFrame, user: str, is_start: Column, clock: str, days: int
) -> DataFrame:
    """Events less than ``days`` whole days after the user's first start event.

    Events before the start have a negative day and stay.  Users without a start
    event drop out.
    """
    return keep_lifetime(with_first_event(df, user, is_start, clock, "reg_dt"), clock, days)


def keep_lifetime(df: DataFrame, clock: str, days: int) -> DataFrame:
    """Rows less than ``days`` whole days after the start time in ``reg_dt``."""
    return df.withColumn("time_after_reg", elapsed_days(clock, "reg_dt")).where(
        F.col("time_after_reg") < days
    )


def user_milestones(
    events: DataFrame, user: str, clock: str, is_start: Column, is_goal: Column
) -> DataFrame:
    """First event, first start and first goal of each user, in one aggregation.

    Whether a user has an event or a goal inside the lifetime window depends on
    the earliest one only, so this replaces the join of all events with their
    start times, and duplicate events need no removal.
    """
    return events.groupBy(user).agg(
        F.min(clock).alias("first_dt"),
        F.min(F.when(is_start, F.col(clock))).alias("reg_dt"),
        F.min(F.when(is_goal, F.col(clock))).alias("goal_dt"),
    )


def lifetime_users(milestones: DataFrame, days: int) -> DataFrame:
    """Users with any event in the window, flagged if they reached the goal in it."""
    inside = elapsed_days("first_dt", "reg_dt") < days
    reached = F.coalesce(elapsed_days("goal_dt", "reg_dt") < days, F.lit(False))
    return milestones.where(inside).withColumn("is_buyer", reached)


def conversion(df: DataFrame, group: str, user: str, is_buyer: Column) -> DataFrame:
    """Distinct users, distinct buyers and their percent per group."""
    per_user = df.groupBy(group, user).agg(
        F.bool_or(F.coalesce(is_buyer, F.lit(False))).alias("bought")
    ).where(F.col(group).isNotNull() & F.col(user).isNotNull())
    return per_user.groupBy(group).agg(
        F.count("*").alias("total_users"), F.count_if("bought").alias("buying_users")
    ).withColumn("cr", half_even(quotient(F.col("buying_users") * 100, "total_users")))


def conversion_diff(rates: DataFrame, group: str, control, test) -> DataFrame:
    """Test minus control conversion in percentage points; one row."""
    return compare_groups(rates, group, "cr", control, test).select(
        half_even(F.col("test_cr") - F.col("control_cr")).alias("diff_cr")
    )


def ztest_precondition(rates: DataFrame, group: str, min_count: int = 10) -> DataFrame:
    """Whether every group has enough buyers and enough non-buyers; one row."""
    return rates.agg(
        F.bool_and(
            (F.col("buying_users") > min_count)
            & (F.col("total_users") - F.col("buying_users") > min_count)
        ).alias("precondition_met")
    )


def required_sample_size(p: float, mde: float, alpha: float, power: float) -> float:
    """Users per group for a two-sided comparison of two equal-sized groups."""
    effect = 2 * math.asin(math.sqrt(p)) - 2 * math.asin(math.sqrt(p + mde))
    normal = NormalDist()
    quantiles = normal.inv_cdf(1 - alpha / 2) + normal.inv_cdf(power)
    return 2 * (quantiles / effect) ** 2


def sample_size_check(
    df: DataFrame, group: str, user: str, p: float, mde: float, alpha: float, power: float
) -> DataFrame:
    """Required and actual users per group."""
    needed = int(required_sample_size(p, mde, alpha, power))
    return (
        group_sizes(df, group, user, "actual_users")
        .withColumn("required_users", F.lit(needed).cast("bigint"))
        .withColumn("is_sufficient", F.col("actual_users") >= F.col("required_users"))
    )


def with_decision(df: DataFrame, p_column: str, alpha: float, out: str = "reject_null") -> DataFrame:
    """Whether the p-value falls below the significance level."""
    return df.withColumn(out, F.col(p_column) < alpha)
