"""Store experiment: integrity, lifetime window, conversion and its test."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tallyframe.functions.numeric import half_even, half_up, mean, total
from tallyframe.functions.text import numeric_details, zone_regions
from tallyframe.operators.experiment import (
    conversion, conversion_diff, duration_days, group_imbalance, group_shares, keep_lifetime,
    lifetime_users, sample_size_check, user_milestones, with_decision, ztest_precondition,
)
from tallyframe.operators.joins import exclude_ids, first_events, overlap
from tallyframe.operators.profile import duplicate_count
from tallyframe.operators.stats import proportions_ztest
from tallyframe.sources.staging import staged

# Names of the tests, groups and events.
TARGET_TEST = "interface_eu_test"
RIVAL_TEST = "recommender_system_test"
CONTROL, TEST = "A", "B"
REGISTRATION, PURCHASE = "registration", "purchase"



def _is_event(name: str) -> Column:
    return F.col("event_name") == name


def experiment_overview(participants: DataFrame, events: DataFrame) -> DataFrame:
    """Duplicates of both tables, before and after the events are deduplicated.

    One grouping of the events tells both: what is left are the different rows.
    """
    counted = duplicate_count(events).select(F.inline(F.array(
        F.struct("row_count", "duplicates", F.lit("events").alias("table_name")),
        F.struct(
            (F.col("row_count") - F.col("duplicates")).alias("row_count"),
            F.lit(0).cast("long").alias("duplicates"), F.lit("events_deduplicated").alias("table_name"),
        ),
    )))
    return duplicate_count(participants).withColumn(
        "table_name", F.lit("participants")
    ).unionByName(counted)


def category_values(participants: DataFrame) -> DataFrame:
    """The different tests, groups and devices."""
    columns = ("ab_test", "group", "device")
    return participants.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(c).alias("value")) for c in columns
    ]))).distinct()


def assignment_check(
    participants: DataFrame, target: str = TARGET_TEST, rival: str = RIVAL_TEST
) -> DataFrame:
    """Group sizes and imbalance of the target test, overlap of groups and of tests."""
    in_target = participants.where(F.col("ab_test") == target)
    sizes = group_imbalance(in_target, "group", "user_id", CONTROL, TEST)
    groups = overlap(in_target, "user_id", F.col("group") == CONTROL, F.col("group") == TEST)
    tests = overlap(participants, "user_id", F.col("ab_test") == target, F.col("ab_test") == rival)

    def entries(df: DataFrame, prefix: str, columns) -> DataFrame:
        return df.select(F.inline(F.array(*[
            F.struct(
                F.lit(prefix + c).alias("measure"), F.col(c).cast("double").alias("value")
            ) for c in columns
        ])))

    sizes = sizes.withColumn("total_users", F.col("control_users") + F.col("test_users"))
    sizes = sizes.withColumn("imbalance", half_up("imbalance"))
    return (
        entries(sizes, "", ["control_users", "test_users", "total_users", "imbalance"])
        .unionByName(entries(groups, "groups_", groups.columns))
        .unionByName(entries(tests, "tests_", tests.columns))
    )


def assignment_shares(participants: DataFrame, target: str = TARGET_TEST) -> DataFrame:
    """Users per group of the target test and their percent."""
    shares = group_shares(participants.where(F.col("ab_test") == target), "group", "user_id")
    return shares.withColumn("share", half_up("share"))


def clean_participants(participants: DataFrame, rival: str = RIVAL_TEST) -> DataFrame:
    """Participants that are not in the rival test."""
    return exclude_ids(participants, participants.where(F.col("ab_test") == rival), "user_id")


def participant_counts(participants: DataFrame, events: DataFrame) -> DataFrame:
    """Participants, those with events, and the days the test covers; one row."""
    clean = clean_participants(participants)
    users = clean.select("user_id").distinct()
    spans = events.groupBy("user_id").agg(
        F.min("event_dt").alias("lo"), F.max("event_dt").alias("hi")
    )
    joined = users.join(spans, "user_id", "left")
    counts = joined.agg(
        F.count("*").alias("users"), F.count("lo").alias("users_with_events"),
        F.min("lo").alias("first"), F.max("hi").alias("last"),
    )
    span = duration_days(
        counts.select(F.explode(F.array("first", "last")).alias("clock")), "clock"
    )
    return counts.select("users", "users_with_events").withColumn("duration_days", span.scalar())


def event_names(participants: DataFrame, events: DataFrame) -> DataFrame:
    """Kinds of events of the clean participants, with the users who have them.

    Participants without any event count under a missing kind.
    """
    users = clean_participants(participants).select("user_id").distinct()
    kinds = events.select("user_id", "event_name").distinct()
    return users.join(kinds, "user_id", "left").groupBy("event_name").agg(
        F.count("*").alias("users")
    )


def lifetime_events(participants: DataFrame, events: DataFrame, days: int = 7) -> DataFrame:
    """Events of the clean participants in the days before and after registration.

    Registration time, group and device are joined per user first, so the events
    meet one small row per user and are joined only once.  Duplicates are removed
    from the events that are left.
    """
    first = first_events(events, "user_id", _is_event(REGISTRATION), "event_dt", "reg_dt")
    per_user = staged(first.join(clean_participants(participants), "user_id"), "lifetime-users")
    joined = events.join(per_user, "user_id")
    return keep_lifetime(joined, "event_dt", days).dropDuplicates()


def lifetime_summary(participants: DataFrame, events: DataFrame, days: int = 7) -> DataFrame:
    """Events per day since registration, with the users active on that day."""
    kept = lifetime_events(participants, events, days)
    per_user = kept.groupBy("time_after_reg", "user_id").agg(F.count("*").alias("n"))
    return per_user.groupBy("time_after_reg").agg(
        F.sum("n").alias("events"), F.count("*").alias("users")
    )


def lifetime_participants(participants: DataFrame, events: DataFrame, days: int = 7) -> DataFrame:
    """Clean participants with any event in the lifetime window, buyers flagged."""
    milestones = user_milestones(
        events, "user_id", "event_dt", _is_event(REGISTRATION), _is_event(PURCHASE)
    )
    return clean_participants(participants).join(lifetime_users(milestones, days), "user_id")


def power_check(
    participants: DataFrame,
    events: DataFrame,
    p: float = 0.3,
    mde: float = 0.03,
    alpha: float = 0.05,
    power: float = 0.8,
) -> DataFrame:
    """Required and actual users per group."""
    users = lifetime_participants(participants, events)
    return sample_size_check(users, "group", "user_id", p, mde, alpha, power)


def conversion_by_group(participants: DataFrame, events: DataFrame) -> DataFrame:
    """Users, buyers, conversion and its distance to the control group."""
    users = lifetime_participants(participants, events)
    rates = conversion(users, "group", "user_id", F.col("is_buyer"))
    control = rates.agg(F.max(F.when(F.col("group") == CONTROL, F.col("cr")))).scalar()
    return rates.withColumn("diff_cr", half_even(F.col("cr") - control))


def conversion_difference(participants: DataFrame, events: DataFrame) -> DataFrame:
    """Test minus control conversion in percentage points; one row."""
    users = lifetime_participants(participants, events)
    return conversion_diff(
        conversion(users, "group", "user_id", F.col("is_buyer")), "group", CONTROL, TEST
    )


def conversion_test(
    participants: DataFrame, events: DataFrame, alpha: float = 0.05, min_count: int = 10
) -> DataFrame:
    """Precondition, z statistic, p-value and decision for a higher test conversion."""
    users = lifetime_participants(participants, events)
    rates = conversion(users, "group", "user_id", F.col("is_buyer"))
    test = proportions_ztest(
        rates, "group", "total_users", "buying_users", CONTROL, TEST, alternative="smaller"
    )
    enough = ztest_precondition(rates, "group", min_count).scalar()
    return with_decision(test, "p_value", alpha).withColumns({
        "precondition_met": enough,
        "z_stat": half_up("z_stat", 6),
        "p_value": half_up("p_value", 6),
    })


# --- the coded details column ----------------------------------------------


def zone_activity(events: DataFrame) -> DataFrame:
    """Events and users per sales region of the zone code.

    A code without any region counts under 'None'.
    """
    regions = zone_regions("details")
    per_user = (
        events.dropDuplicates()
        .where(regions.isNotNull())
        .select("user_id", F.explode(
            F.when(F.size(regions) == 0, F.array(F.lit("None"))).otherwise(regions)
        ).alias("region"))
        .groupBy("region", "user_id").agg(F.count("*").alias("n"))
    )
    return per_user.groupBy("region").agg(
        F.sum("n").alias("events"), F.count("*").alias("users")
    )


def money_by_group(participants: DataFrame, events: DataFrame) -> DataFrame:
    """Acquisition cost of registrations and revenue of purchases per test group."""
    amount = numeric_details("details")
    per_user = events.dropDuplicates().groupBy("user_id").agg(
        F.sum(F.when(_is_event(REGISTRATION), amount)).alias("cost"),
        F.sum(F.when(_is_event(PURCHASE), amount)).alias("revenue"),
        F.count(F.when(_is_event(PURCHASE), amount)).alias("purchases"),
    )
    joined = clean_participants(participants).join(per_user, "user_id", "left")
    return joined.groupBy("group").agg(
        F.count_distinct("user_id").alias("users"),
        total("cost").alias("acquisition_cost"),
        total("revenue").alias("revenue"),
        F.coalesce(F.sum("purchases"), F.lit(0)).alias("purchases"),
        half_up(mean("cost")).alias("cost_per_registered"),
    )
