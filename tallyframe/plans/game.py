"""Online game: payers, purchases, items and purchase frequency."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tallyframe.functions.numeric import half_up, mean, percent, quotient, total
from tallyframe.functions.text import labelled
from tallyframe.operators.joins import left_join_filtered, lookup, null_safe_join
from tallyframe.operators.metrics import entity_span, share_of_total
from tallyframe.operators.profile import (
    fk_check, key_check, null_breakdown, preview, profile_columns, rows_with_nulls,
)
from tallyframe.operators.ranking import percentile_disc, tiers
from tallyframe.sources.files import catalog
from tallyframe.sources.schemas import TableKeys

# Output labels.
PAYER_LABEL = "Платящие игроки"
NON_PAYER_LABEL = "Неплатящие игроки"
FREQUENCY_LABELS = ("высокая частота", "умеренная частота", "низкая частота")

USER_COLUMNS = ("class_id", "ch_id", "pers_gender", "server", "race_id", "payer", "loc_id")
EVENT_COLUMNS = ("date", "time", "amount", "seller_id")


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def column_catalog(tables: Mapping[str, DataFrame], keys: Mapping[str, TableKeys]) -> DataFrame:
    """Columns of every table with position, type and declared keys, next to what they hold.

    A column under two constraints has two rows.
    """
    counts = _union([
        profile_columns(df).select(
            F.lit(name).alias("table_name"), "column_name", "row_count", "non_null_count"
        ) for name, df in tables.items()
    ])
    return catalog(tables, keys).join(counts, ["table_name", "column_name"]).select(
        "table_name", "position", "column_name", "data_type", "key_role", "parent_table",
        "parent_column", "row_count", "non_null_count",
    )


def table_overview(tables: Mapping[str, DataFrame], keys: Mapping[str, TableKeys]) -> DataFrame:
    """Columns, types, key role, row and non-null counts of every table."""
    return column_catalog(tables, keys).drop("position", "parent_table", "parent_column")


def key_checks(tables: Mapping[str, DataFrame], keys: Mapping[str, TableKeys]) -> DataFrame:
    """Whether each declared primary key is unique and complete."""
    return _union([
        key_check(df, keys[name].primary).withColumn("table_name", F.lit(name))
        for name, df in tables.items()
    ])


def reference_checks(tables: Mapping[str, DataFrame], keys: Mapping[str, TableKeys]) -> DataFrame:
    """Rows of each declared foreign key that have no parent."""
    parts = []
    for name, df in tables.items():
        for column, (parent, parent_column) in keys[name].foreign.items():
            parts.append(fk_check(df, column, tables[parent], parent_column).withColumns({
                "table_name": F.lit(name), "column_name": F.lit(column),
                "parent_table": F.lit(parent),
            }))
    return _union(parts)


def table_preview(users: DataFrame, n: int = 5) -> DataFrame:
    """The first users, each with the row count of the table."""
    return preview(users, n, "id")


def null_audit(users: DataFrame, events: DataFrame) -> DataFrame:
    """Incomplete rows of both tables and what is filled in them."""

    def counts(name: str, df: DataFrame, columns: Sequence[str]) -> DataFrame:
        row = null_breakdown(df, columns)
        entries = [
            F.struct(F.lit(c).alias("measure"), F.col(c).alias("value")) for c in row.columns
        ]
        return row.select(F.lit(name).alias("table_name"), F.inline(F.array(*entries)))

    return counts("users", users, USER_COLUMNS).unionByName(
        counts("events", events, EVENT_COLUMNS)
    )


def incomplete_users(users: DataFrame) -> DataFrame:
    """The users with at least one gap."""
    return rows_with_nulls(users, USER_COLUMNS)


def category_counts(users: DataFrame, column: str = "server") -> DataFrame:
    return users.groupBy(column).agg(F.count("*").alias("row_count"))


def payer_share(users: DataFrame) -> DataFrame:
    """Users, payers and the payers' percent."""
    return users.agg(
        F.count("id").alias("count_all_user"), F.sum("payer").alias("count_pay_user")
    ).withColumn("share_pay_user", percent("count_pay_user", "count_all_user"))


def payer_share_by_dim(users: DataFrame, race: DataFrame) -> DataFrame:
    """Users, payers and percent per race, largest race first.

    Users are counted per race id before the lookup, so the join sees one row
    per race; races that share a name are added up afterwards.
    """
    per_id = users.groupBy("race_id").agg(
        F.count("id").alias("all_n"), F.sum("payer").alias("pay_n")
    )
    return (
        lookup(per_id, race, "race_id").groupBy("race")
        .agg(F.sum("pay_n").alias("count_pay_user"), F.sum("all_n").alias("count_all_user"))
        .withColumn("share_pay_user", percent("count_pay_user", "count_all_user"))
        .orderBy(F.col("count_all_user").desc(), F.col("race").asc_nulls_last())
    )


def amount_stats(events: DataFrame) -> DataFrame:
    """Count, sum, extremes, average, discrete median and deviation of amounts."""
    middle = percentile_disc(events, "amount", "0.5", "median").select("median").scalar()
    return events.agg(
        F.count("*").alias("count_event"),
        total("amount").alias("total_amount"),
        F.min("amount").cast("double").alias("min_amount"),
        F.max("amount").cast("double").alias("max_amount"),
        half_up(mean("amount")).alias("avg_amount"),
        half_up(F.stddev_samp(F.col("amount").cast("double"))).alias("stand_dev_amount"),
    ).withColumn("median_amount", middle.cast("double"))


def zero_purchases(events: DataFrame) -> DataFrame:
    """All purchases, those without a cost and their fraction."""
    return events.agg(
        F.count("*").alias("total_event"),
        F.count_if(F.col("amount") == 0).alias("count_zero_cost"),
    ).withColumn("share_zero_cost", quotient("count_zero_cost", "total_event"))


def _purchases(events: DataFrame) -> DataFrame:
    """Rows and amount per user and transaction, paid events apart from free ones."""
    return events.groupBy("id", "transaction_id", (F.col("amount") > 0).alias("is_paid")).agg(
        F.count("transaction_id").alias("n"), total("amount").alias("paid")
    )


def payer_vs_nonpayer(users: DataFrame, events: DataFrame) -> DataFrame:
    """Buyers, average purchases and average spending by payer status."""
    per_user = _purchases(events).where("is_paid").groupBy("id").agg(
        F.sum("n").alias("n_event"), total("paid").alias("paid")
    )
    buyers = users.select("id", "payer").join(per_user, "id")
    return buyers.groupBy("payer").agg(
        F.count("*").alias("count_pay_user"),
        half_up(quotient(F.sum("n_event"), F.count("*")), 0).alias("avg_count_event"),
        half_up(quotient(total("paid"), F.count("*"))).alias("avg_amount_user"),
    ).withColumn("payer", labelled("payer", {1: PAYER_LABEL}, NON_PAYER_LABEL))


def item_popularity(events: DataFrame, items: DataFrame) -> DataFrame:
    """Paid events per item with their share, and the share of users who bought it.

    The second share is taken of all users with any event, unpaid ones included.
    """
    per_item = events.where(F.col("amount") > 0).groupBy("item_code").agg(
        F.count("transaction_id").alias("count_event"), F.count_distinct("id").alias("n_user")
    )
    named = per_item.join(items, "item_code").select(
        F.col("item_code").alias("epic_item_id"), F.col("game_items").alias("epic_item_name"),
        "count_event", "n_user",
    )
    everyone = events.agg(F.count_distinct("id")).scalar()
    return (
        share_of_total(named, "count_event", "share_event")
        .withColumn("share_buy_user", half_up(quotient(F.col("n_user") * 100, everyone)))
        .drop("n_user")
        .orderBy(F.col("count_event").desc(), "epic_item_id")
    )


def activity_by_dim(users: DataFrame, events: DataFrame, race: DataFrame) -> DataFrame:
    """Users, buyers, payers among buyers and purchase averages per race.

    Users without a paid event stay in the count of users.  The share of payers
    is missing where a race has no paying buyer.
    """
    joined = left_join_filtered(
        users.select("id", "race_id", "payer"), _purchases(events), "id", F.col("is_paid")
    )
    per_user = joined.groupBy("race_id", "id", "payer").agg(
        F.count("is_paid").alias("n"), total("paid").alias("paid")
    )
    buyer = F.col("n") > 0
    people = per_user.groupBy("race_id").agg(
        F.count("id").alias("count_total_user"),
        F.count_if(buyer).alias("count_buy_user"),
        F.count_if(buyer & (F.col("payer") == 1)).alias("n_payer"),
        total("paid").alias("paid"),
    )
    # An id that two users share is one transaction of their race.
    transactions = joined.where("transaction_id is not null").select(
        "race_id", "transaction_id"
    ).distinct().groupBy("race_id").agg(F.count("*").alias("n_event"))
    per_race = null_safe_join(people, transactions, ["race_id"], "left")
    payers = F.when(F.col("race_id").isNotNull() & (F.col("n_payer") > 0), F.col("n_payer"))
    return (
        lookup(per_race, race, "race_id")
        .select(
            "race", "count_total_user", "count_buy_user",
            percent("count_buy_user", "count_total_user").alias("share_buy_of_total_user"),
            percent(payers, F.col("count_buy_user")).alias("share_pay_of_buy_user"),
            half_up(quotient("n_event", "count_buy_user"), 0).alias("avg_event"),
            half_up(quotient("paid", "n_event")).alias("avg_amount_event"),
            half_up(quotient("paid", "count_buy_user")).alias("avg_amount_user"),
        )
        .orderBy(F.col("count_total_user").desc(), F.col("race").asc_nulls_last())
    )


def purchase_gaps(users: DataFrame, events: DataFrame, min_events: int) -> DataFrame:
    """Frequent buyers with their purchases and mean days between purchases."""
    spans = entity_span(
        events.where(F.col("amount") > 0), ["id"], "date", "duration_day", "count_event"
    ).where(F.col("count_event") >= min_events)
    return lookup(spans, users.select("id", "payer"), "id").withColumn(
        "avg_duration_day",
        half_up(quotient("duration_day", F.col("count_event") - 1)).cast("decimal(18,2)"),
    )


def _tier_label(tier: Column, labels: Sequence[str]) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in labels]), tier)


def purchase_frequency_tiers(
    users: DataFrame,
    events: DataFrame,
    min_events: int = 25,
    labels: Sequence[str] = FREQUENCY_LABELS,
) -> DataFrame:
    """Frequent buyers in equal tiers by mean days between purchases.

    The per-buyer table is written once, in the order of the gaps.  A single
    purchase has no gap and cannot be ranked, so ``min_events`` must be at least 2.
    """
    if min_events < 2:
        raise ValueError("min_events must be at least 2: one purchase has no gap")
    gaps = purchase_gaps(users, events, min_events)
    ranked = tiers(gaps, len(labels), "avg_duration_day", "id", "tier")
    return (
        ranked.groupBy("tier").agg(
            F.count("id").alias("count_buy_user"),
            F.sum("payer").alias("count_pay_user"),
            half_up(quotient(F.sum("count_event"), F.count("id")), 0).alias("avg_count_event"),
            half_up(quotient(F.sum("avg_duration_day"), F.count("id"))).alias("avg_duration_day"),
        )
        .withColumn("share_pay_of_buy_user", percent("count_pay_user", "count_buy_user"))
        .orderBy("tier")
        .withColumn("ranc_duration", _tier_label(F.col("tier"), labels))
        .drop("tier")
    )
