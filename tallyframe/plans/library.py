"""Online library: monthly audience, retention, lifetime value, revenue per hour."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tallyframe.functions.numeric import half_up, quotient, total
from tallyframe.functions.temporal import month_start, to_day
from tallyframe.operators.joins import lookup
from tallyframe.operators.metrics import retention
from tallyframe.operators.ranking import top_k

# Fixed value: monthly price of a subscription.
SUBSCRIPTION_PRICE = 399


def with_day(audition: DataFrame) -> DataFrame:
    """Turn the textual date into a date once."""
    return audition.withColumn("day", to_day("msk_business_dt_str")).drop("msk_business_dt_str")


def rejected_dates(audition: DataFrame) -> DataFrame:
    """Rows, and rows whose date text is not a date and would drop out; one row."""
    bad = F.col("msk_business_dt_str").isNotNull() & to_day("msk_business_dt_str").isNull()
    return audition.agg(F.count("*").alias("row_count"), F.count_if(bad).alias("rejected"))


def _readers(audition: DataFrame, month: int) -> DataFrame:
    """Distinct (content, user) pairs of a calendar month, any year."""
    return with_day(audition).where(F.month("day") == month).select(
        "main_content_id", "puid"
    ).distinct()


def mau_top_authors(
    audition: DataFrame, content: DataFrame, author: DataFrame, month: int = 11, k: int = 3
) -> DataFrame:
    """Authors with the most distinct users in a month."""
    named = lookup(_readers(audition, month), content, "main_content_id")
    named = lookup(named, author, "main_author_id")
    counted = named.groupBy("main_author_name").agg(F.count_distinct("puid").alias("mau"))
    return top_k(counted, "mau", k, ["main_author_name"])


def mau_top_titles(
    audition: DataFrame, content: DataFrame, author: DataFrame, month: int = 11, k: int = 3
) -> DataFrame:
    """Titles with the most distinct users in a month, with topics and author."""
    named = lookup(_readers(audition, month), content, "main_content_id")
    named = lookup(named, author, "main_author_id")
    keys = ["main_content_name", "published_topic_title_list", "main_author_name"]
    counted = named.groupBy(*keys).agg(F.count_distinct("puid").alias("mau"))
    return top_k(counted, "mau", k, keys)


def daily_retention(audition: DataFrame, base_day: str = "2024-12-02") -> DataFrame:
    """Share of the base day's users that return on each later day.

    Dates are texts as yyyy-mm-dd, which order as the dates do, so the lower bound
    on the text reaches the scan and skips earlier files.
    """
    later = audition.where(F.col("msk_business_dt_str") >= base_day)
    return retention(with_day(later), "puid", "day", base_day).orderBy("day_since_install")


def ltv_by_city(
    audition: DataFrame, geo: DataFrame, cities: Sequence[str], price: int = SUBSCRIPTION_PRICE
) -> DataFrame:
    """Users per city and their average revenue: one price per active month.

    A user seen in two cities counts in both.
    """
    wanted = geo.where(F.col("usage_geo_id_name").isin(list(cities))).select(
        "usage_geo_id", F.col("usage_geo_id_name").alias("city")
    )
    months = (
        with_day(audition).join(wanted, "usage_geo_id")
        .select("city", "puid", month_start("day").alias("month")).distinct()
    )
    per_user = months.groupBy("city", "puid").agg((F.count("month") * price).alias("ltv"))
    return per_user.groupBy("city").agg(
        F.count("puid").alias("total_users"),
        half_up(quotient(F.sum("ltv"), F.count("ltv"))).alias("ltv"),
    )


def revenue_per_hour(
    audition: DataFrame, first_month: int = 9, last_month: int = 11, price: int = SUBSCRIPTION_PRICE
) -> DataFrame:
    """Monthly users, hours and revenue per hour.

    The months are pooled into users first, so that the distinct count needs no
    second copy of the rows next to the sum of hours.
    """
    dated = with_day(audition).where(F.month("day").between(first_month, last_month))
    per_user = dated.groupBy(month_start("day").alias("month_b"), "puid").agg(
        total("hours").alias("user_hours")
    )
    return per_user.groupBy("month_b").agg(
        F.count("puid").alias("mau"),
        half_up(total("user_hours")).alias("hours"),
        half_up(quotient(F.count("puid") * price, total("user_hours"))).alias("avg_hour_rev"),
    )
