"""Real-estate listings: time on market, seasonality, towns, overview tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tallyframe.functions.numeric import (
    half_up, known, mean, percent, quotient, total, within_or_null,
)
from tallyframe.functions.temporal import month_name, month_start
from tallyframe.functions.text import bucketed, labelled
from tallyframe.operators.joins import lookup, null_safe_join
from tallyframe.operators.metrics import share_within, with_ratio
from tallyframe.operators.ranking import (
    few_valued_percentile, percentiles, rank_groups, top_k,
)
from tallyframe.sources.staging import staged

# Names and labels of the studied market.
MAIN_CITY = "Санкт-Петербург"
OTHER_REGION = "Ленинградская область"
TOWN_TYPE = "город"
PERIOD_BOUNDS = (30, 90, 180, 365)
PERIOD_LABELS = (
    "1_до 1 месяца", "2_до 3 месяцев", "3_до 6 месяцев", "4_до 12 месяцев", "5_свыше 12 месяцев",
)
# Output name -> (column, fraction).
LIMITS = {
    "price_high": ("price_1m", "0.99"),
    "price_low": ("price_1m", "0.01"),
    "area_high": ("total_area", "0.99"),
    "rooms_high": ("rooms", "0.99"),
    "balcony_high": ("balcony", "0.99"),
    "ceiling_high": ("ceiling_height", "0.99"),
    "ceiling_low": ("ceiling_height", "0.01"),
}
USED_LIMITS = [name for name in LIMITS if name != "area_high"]

MEASURES = ("price_1m", "total_area", "rooms", "balcony", "ceiling_height")


def priced_listings(flats: DataFrame, advertisement: DataFrame) -> DataFrame:
    """Flats with their advertisement and the price per square metre."""
    return with_ratio(
        flats.join(advertisement, "id"), "last_price", "total_area", "price_1m"
    )


def staged_listings(flats: DataFrame, advertisement: DataFrame, *columns: str) -> DataFrame:
    """The joined listings, written once: limits and reports read them repeatedly.

    Only the measures with a limit and the named columns are written.
    """
    return staged(
        priced_listings(flats, advertisement).select(*MEASURES, *columns), "listings"
    )


def outlier_limits(listings: DataFrame) -> DataFrame:
    """First and 99th percentile of the measures; one row.

    The limit of the total area belongs to the report but filters nothing.
    """
    return percentiles(listings, LIMITS)


def without_outliers(listings: DataFrame) -> DataFrame:
    """Listings strictly inside the limits; missing optional measures are kept."""
    row = percentiles(listings, {n: LIMITS[n] for n in USED_LIMITS}).first()
    # Constants instead of a subquery, so that they reach the scan as filters.
    limit = {n: F.lit(row[n]) for n in USED_LIMITS}
    price = F.col("price_1m")
    return listings.where(
        (price < limit["price_high"]) & (price > limit["price_low"])
        & within_or_null("rooms", high=limit["rooms_high"])
        & within_or_null("balcony", high=limit["balcony_high"])
        & within_or_null("ceiling_height", limit["ceiling_low"], limit["ceiling_high"])
    )


def _in_towns(listings: DataFrame, types: DataFrame, town_type: str) -> DataFrame:
    return listings.join(types.where(F.col("type") == town_type).select("type_id"), "type_id")


def _rounded_mean(column: str, digits: int = 2) -> Column:
    return half_up(mean(column), digits)


def time_on_market_segments(
    flats: DataFrame,
    advertisement: DataFrame,
    city: DataFrame,
    types: DataFrame,
    main_city: str = MAIN_CITY,
    town_type: str = TOWN_TYPE,
    bounds: Sequence[int] = PERIOD_BOUNDS,
    labels: Sequence[str] = PERIOD_LABELS,
    other_region: str = OTHER_REGION,
) -> DataFrame:
    """Closed listings by region and time on market."""
    kept = without_outliers(staged_listings(
        flats, advertisement,
        "city_id", "type_id", "floors_total", "is_apartment", "days_exposition",
    ))
    closed = _in_towns(kept.where(F.col("days_exposition").isNotNull()), types, town_type)
    keys = ["region", "period"]
    segmented = lookup(closed, city, "city_id").select(
        labelled("city", {main_city: main_city}, other_region).alias("region"),
        bucketed("days_exposition", bounds, labels).alias("period"),
        "is_apartment", "price_1m", "total_area", "rooms", "balcony", "floors_total",
    )
    # A row per segment and number of floors answers averages and the median of floors.
    measures = ("price_1m", "total_area", "rooms", "balcony")
    by_floors = staged(segmented.groupBy(*keys, "floors_total").agg(
        F.count("*").alias("n"), F.sum("is_apartment").alias("apartments"),
        *[total(m).alias(f"{m}_sum") for m in measures],
        *[F.count(known(m)).alias(f"{m}_n") for m in measures],
    ), "segments")

    def average(measure: str, digits: int = 2) -> Column:
        return half_up(quotient(total(f"{measure}_sum"), F.sum(f"{measure}_n")), digits)

    grouped = by_floors.groupBy(*keys).agg(
        F.sum("n").alias("flats"),
        F.sum("apartments").alias("apartments"),
        average("price_1m").alias("price_per_m2"),
        average("total_area").alias("total_area"),
        average("rooms", 0).alias("rooms"),
        average("balcony", 0).alias("balconies"),
    )
    floors = few_valued_percentile(by_floors, "floors_total", "0.5", "floors", by=keys, count="n")
    shares = share_within(grouped, ["region"], "flats", "share")
    return null_safe_join(shares, floors, keys, "left").withColumn(
        "floors", F.col("floors").cast("double")
    ).orderBy(F.col("region").desc(), "period")


def seasonality(
    flats: DataFrame,
    advertisement: DataFrame,
    types: DataFrame,
    town_type: str = TOWN_TYPE,
    opened: tuple[int, int] = (2015, 2018),
    closed: tuple[int, int] = (2017, 2018),
) -> DataFrame:
    """Calendar months by opened and by closed listings, years pooled."""
    kept = without_outliers(staged_listings(
        flats, advertisement, "type_id", "first_day_exposition", "days_exposition"
    ))
    towns = _in_towns(kept, types, town_type)
    last_day = F.date_add("first_day_exposition", F.col("days_exposition"))

    def by_month(day: Column, years: tuple[int, int], prefix: str) -> DataFrame:
        grouped = (
            towns.withColumn("day", day).where(F.year("day").between(*years))
            .groupBy(F.month("day").alias("month")).agg(
                F.count("*").alias(f"{prefix}_count_adv"),
                _rounded_mean("price_1m").alias(f"{prefix}_avg_price_1m"),
                _rounded_mean("total_area").alias(f"{prefix}_avg_area"),
            )
        )
        return rank_groups(grouped, f"{prefix}_count_adv", f"{prefix}_rank")

    sale = by_month(F.col("first_day_exposition"), opened, "sale")
    buy = by_month(last_day, closed, "buy")
    return (
        sale.join(buy, "month").orderBy("month")
        .withColumn("month_name", month_name("month")).drop("month")
    )


def top_towns(
    flats: DataFrame,
    advertisement: DataFrame,
    city: DataFrame,
    main_city: str = MAIN_CITY,
    k: int = 15,
) -> DataFrame:
    """Towns outside the main city with the most listings; no filter on town type."""
    kept = without_outliers(staged_listings(
        flats, advertisement, "city_id", "days_exposition"
    ))
    towns = kept.join(city.where(F.col("city") != main_city), "city_id")
    grouped = towns.groupBy("city").agg(
        F.count("*").alias("listings"),
        percent(F.count_if(F.col("days_exposition").isNotNull()), F.count("*")).alias("closed_share"),
        _rounded_mean("price_1m").alias("price_per_m2"),
        _rounded_mean("total_area").alias("total_area"),
        _rounded_mean("days_exposition", 0).alias("days_exposition"),
    )
    return top_k(grouped, "listings", k, ["city"])


# --- tables behind the dashboard -------------------------------------------


def market_overview(flats: DataFrame) -> DataFrame:
    """Listings, average areas and average rooms; one row."""
    return flats.agg(
        F.count("*").alias("listings"),
        _rounded_mean("total_area").alias("total_area"),
        _rounded_mean("living_area").alias("living_area"),
        _rounded_mean("kitchen_area").alias("kitchen_area"),
        _rounded_mean("rooms").alias("rooms"),
    )


def listing_dynamics(advertisement: DataFrame) -> DataFrame:
    """Listings, average price and average exposition per opening month."""
    return advertisement.groupBy(month_start("first_day_exposition").alias("month")).agg(
        F.count("*").alias("listings"),
        _rounded_mean("last_price").alias("avg_price"),
        _rounded_mean("days_exposition").alias("avg_days_exposition"),
    ).orderBy("month")


def town_price_per_area(flats: DataFrame, advertisement: DataFrame, city: DataFrame) -> DataFrame:
    """Average price per square metre of every town."""
    listings = priced_listings(flats, advertisement)
    grouped = listings.groupBy("city_id").agg(
        F.sum("price_1m").alias("price_sum"), F.count("price_1m").alias("n")
    )
    return lookup(grouped, city, "city_id").groupBy("city").agg(
        half_up(quotient(F.sum("price_sum"), F.sum("n"))).alias("price_per_m2")
    )


def top_towns_by_measure(
    flats: DataFrame, advertisement: DataFrame, city: DataFrame, k: int = 5
) -> DataFrame:
    """The leading towns by listings, by average price and by average exposition."""
    joined = flats.select("id", "city_id").join(advertisement, "id")
    per_id = joined.groupBy("city_id").agg(
        F.count("*").alias("n"),
        F.sum("last_price").alias("price_sum"), F.count("last_price").alias("price_n"),
        F.sum("days_exposition").alias("days_sum"), F.count("days_exposition").alias("days_n"),
    )
    towns = lookup(per_id, city, "city_id").groupBy("city").agg(
        F.sum("n").cast("double").alias("listings"),
        half_up(quotient(F.sum("price_sum"), F.sum("price_n"))).alias("avg_price"),
        half_up(quotient(F.sum("days_sum"), F.sum("days_n"))).alias("avg_days_exposition"),
    )
    parts = [
        top_k(
            towns.select(F.lit(m).alias("measure"), "city", F.col(m).alias("value")),
            "value", k, ["city"],
        )
        for m in ("listings", "avg_price", "avg_days_exposition")
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
