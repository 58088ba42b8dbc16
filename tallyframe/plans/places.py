"""Restaurants: profile, cleaning, categories, seats, ratings, chains, bills."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from tallyframe.functions.numeric import half_even, half_up, mean
from tallyframe.functions.text import bill_middle
from tallyframe.operators.association import association, chi_square, contingency
from tallyframe.operators.clean import (
    cast_columns, dedupe_first, drop_missing, keyword_flag, map_values, normalise_text,
    presence_flag, replace_text,
)
from tallyframe.operators.joins import keep_ids, lookup, null_safe_join
from tallyframe.operators.metrics import group_means_with_total
from tallyframe.operators.profile import (
    describe, duplicate_count, missing_report, pivot_count, profile_columns, share_matrix,
    value_counts, value_shares,
)
from tallyframe.operators.ranking import median, top_k
from tallyframe.operators.stats import box_stats, histogram
from tallyframe.sources.staging import staged

# Abbreviations of the administrative districts.
DISTRICTS = {
    "Центральный административный округ": "ЦАО",
    "Северный административный округ": "САО",
    "Северо-Восточный административный округ": "СВАО",
    "Южный административный округ": "ЮАО",
    "Западный административный округ": "ЗАО",
    "Восточный административный округ": "ВАО",
    "Юго-Западный административный округ": "ЮЗАО",
    "Юго-Восточный административный округ": "ЮВАО",
    "Северо-Западный административный округ": "СЗАО",
}
# The merged category, the words of round-the-clock work, the
# centre, the limits of plausible values and the prefixes of bill texts.
BAR_CATEGORY = ("бар,паб", "бар")
ROUND_THE_CLOCK = ("ежедневно", "круглосуточно")
CENTRE = "ЦАО"
MAX_SEATS = 800
MAX_BILL = 10000
BILL_PREFIX = "Средний счёт"
COFFEE_PREFIX = "Цена чашки капучино"

ASSOCIATED = ("category", "district", "chain", "seats", "price", "is_24_7")
INTERVAL = ("rating", "chain", "seats", "is_24_7")


def merged(info: DataFrame, price: DataFrame) -> DataFrame:
    """Every place with its prices, if it has any."""
    return lookup(info, price, "id")


def dataset_profile(info: DataFrame, price: DataFrame) -> DataFrame:
    """Type, rows, gaps and percent of gaps of every column of both files."""
    parts = []
    for name, df in (("ctr_info", info), ("ctr_price", price)):
        gaps = missing_report(df).withColumn("missing_percent", half_up("missing_percent", 4))
        parts.append(
            profile_columns(df).join(gaps, "column_name").withColumn("table_name", F.lit(name))
        )
    return parts[0].unionByName(parts[1])


def merge_price(info: DataFrame, price: DataFrame) -> DataFrame:
    """How many merged rows come from each file; one row."""
    flagged = merged(
        info.withColumn("from_info", F.lit(True)), price.withColumn("from_price", F.lit(True))
    )
    return flagged.agg(
        F.count("*").alias("merged_rows"),
        F.count("from_info").alias("rows_in_info"),
        F.count("from_price").alias("rows_in_price"),
    )


def missingness_by_dim(info: DataFrame) -> DataFrame:
    """Places with and without opening hours per district and per chain flag."""
    flagged = presence_flag(info, "hours", "is_hours")
    parts = [
        pivot_count(
            flagged.withColumn("value", F.col(c).cast("string")),
            "value", "is_hours", "id", [0, 1], "is_hours_",
        ).withColumn("dimension", F.lit(c))
        for c in ("district", "chain")
    ]
    return parts[0].unionByName(parts[1])


def normalised_places(df: DataFrame) -> DataFrame:
    """Places with known hours and normalised name and address."""
    return normalise_text(drop_missing(df, ["hours"]), ["name", "address"])


def clean_places(
    info: DataFrame,
    price: DataFrame | None = None,
    districts: Mapping[str, str] = DISTRICTS,
    category: tuple[str, str] = BAR_CATEGORY,
    words: Sequence[str] = ROUND_THE_CLOCK,
) -> DataFrame:
    """The cleaned table of places that all later questions use.

    Of several places with one name and address the one with the lowest id stays.
    Prices are attached by id after that, to fewer rows, and only for the questions
    that need them.
    """
    unique = dedupe_first(normalised_places(info), ["name", "address"], "id")
    if price is not None:
        unique = merged(unique, price)
    unified = map_values(replace_text(unique, "category", *category), "district", districts)
    return presence_flag(
        keyword_flag(unified, "hours", words, "is_24_7"), "hours", "is_hours"
    )


def duplicate_places(info: DataFrame) -> DataFrame:
    """Duplicates by name and address before and after normalisation; two rows."""
    known = drop_missing(info, ["hours"])
    key = ["name", "address"]
    raw = duplicate_count(known, key).withColumn("stage", F.lit("raw"))
    clean = duplicate_count(normalised_places(info), key).withColumn("stage", F.lit("normalised"))
    full = duplicate_count(known).withColumn("stage", F.lit("full_row"))
    return raw.unionByName(clean).unionByName(full)


def optimised_types(df: DataFrame) -> DataFrame:
    """Ratings as single precision, flags as bytes."""
    return cast_columns(df, {"rating": "float", "chain": "tinyint"})


def _counts(df: DataFrame, column: str, question: str) -> DataFrame:
    return value_counts(df, column, "places").select(
        F.lit(question).alias("question"), F.col(column).alias("value"), "places"
    )


def category_distribution(places: DataFrame, centre: str = CENTRE) -> DataFrame:
    """Places per category, per district, and per category inside the centre."""
    places = staged(places.select("category", "district"), "places")
    central = places.where(F.col("district") == centre)
    return (
        _counts(places, "category", "category")
        .unionByName(_counts(places, "district", "district"))
        .unionByName(_counts(central, "category", "category_in_centre"))
    )


def name_counts(places: DataFrame, k: int = 20) -> DataFrame:
    """The most frequent names."""
    counted = places.groupBy("name").agg(F.count("*").alias("places"))
    return top_k(counted, "places", k, ["name"])


def name_profile(places: DataFrame, name: str) -> DataFrame:
    """Categories of the places with one name, and how many belong to a chain."""
    return places.where(F.col("name") == name).groupBy("category").agg(
        F.count("*").alias("places"), F.count_if(F.col("chain") == 1).alias("chain_places")
    )


def place_values(places: DataFrame) -> DataFrame:
    """The different values of the category columns, missing ones included."""
    columns = ("category", "district", "price", "chain")
    return places.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value"))
        for c in columns
    ]))).distinct()


def chain_share(places: DataFrame) -> DataFrame:
    """Fraction of chain and independent places, overall and per category."""
    places = staged(places.select("category", "chain"), "chain-flags")
    overall = value_shares(places, "chain", "share").agg(
        F.coalesce(F.max(F.when(F.col("chain") == 0, F.col("share"))), F.lit(0.0)).alias("chain_0"),
        F.coalesce(F.max(F.when(F.col("chain") == 1, F.col("share"))), F.lit(0.0)).alias("chain_1"),
    ).withColumn("category", F.lit("all"))
    table = share_matrix(places, "category", "chain", [0, 1], "chain_").unionByName(overall)
    return table.withColumns({c: half_up(c, 6) for c in ("chain_0", "chain_1")})


def typical_seats(places: DataFrame, max_seats: int = MAX_SEATS) -> DataFrame:
    """Mean and median seats per category, implausible counts left out."""
    kept = staged(places.where(F.col("seats") < max_seats).select("category", "seats"), "seats")
    known = kept.where(F.col("category").isNotNull())
    means = known.groupBy("category").agg(
        F.count("seats").alias("places"), half_even(mean("seats")).alias("mean_seats")
    )
    middles = median(known, "seats", "median_seats", by=["category"])
    return null_safe_join(means, middles, ["category"], "left").withColumn(
        "median_seats", half_even("median_seats")
    ).orderBy("median_seats", "category")


def seats_summary(places: DataFrame, max_seats: int = MAX_SEATS) -> DataFrame:
    """Distribution of seats and the number of implausible counts; one row."""
    seats = staged(places.select("seats"), "seats")
    beyond = seats.agg(F.count_if(F.col("seats") >= max_seats)).scalar()
    stats = describe(seats, "seats")
    measures = ["mean", "std", "var", "min", "q25", "q50", "q75", "max"]
    return stats.select("count", *[half_up(m, 4).alias(m) for m in measures]).withColumn(
        "outliers", beyond
    )


def seats_box(places: DataFrame) -> DataFrame:
    """Box-plot numbers of seats; one row."""
    stats = box_stats(staged(places.select("seats"), "seats"), "seats")
    measures = ["q25", "q50", "q75", "whisker_low", "whisker_high"]
    return stats.select("count", *[half_up(m, 4).alias(m) for m in measures], "outliers")


def rating_by_category(places: DataFrame) -> DataFrame:
    """Mean rating per category next to the mean over all places."""
    means = group_means_with_total(places, "category", "rating", "mean_rating", "overall_rating")
    return means.orderBy(F.col("mean_rating").desc(), "category").withColumns({
        c: half_even(c) for c in ("mean_rating", "overall_rating")
    })


def rating_histogram(places: DataFrame, bins: int = 20) -> DataFrame:
    """Places per rating bin."""
    return histogram(staged(places.select("rating"), "ratings"), "rating", bins)


def rating_summary(places: DataFrame) -> DataFrame:
    """Distribution of ratings; one row."""
    stats = describe(staged(places.select("rating"), "ratings"), "rating")
    measures = ["mean", "std", "var", "min", "q25", "q50", "q75", "max"]
    return stats.select("count", *[half_up(m, 4).alias(m) for m in measures])


def rating_association(places: DataFrame, bins: int = 10) -> DataFrame:
    """Association of every other attribute with the rating, strongest first."""
    columns = staged(places.select("rating", *ASSOCIATED), "associated")
    return association(columns, "rating", ASSOCIATED, INTERVAL, bins).orderBy(
        F.col("phi_k").desc_nulls_last(), "column_name"
    ).withColumns({
        "chi2": half_up("chi2", 6), "cramers_v": half_up("cramers_v", 6), "phi_k": half_up("phi_k", 4),
    })


def rating_chi_square(places: DataFrame, bins: int = 10) -> DataFrame:
    """The closed-form part of the association: chi-square and Cramer's V."""
    columns = staged(places.select("rating", *ASSOCIATED), "associated")
    return chi_square(contingency(columns, "rating", ASSOCIATED, INTERVAL, bins)).withColumns(
        {c: half_up(c, 6) for c in ("chi2", "cramers_v")}
    )


def rating_by_price(places: DataFrame) -> DataFrame:
    """Mean rating and box-plot numbers per price class, best class first."""
    everything = staged(places.select("price", "rating"), "price-ratings")
    rated = everything.where(F.col("price").isNotNull())
    overall = everything.agg(mean("rating")).scalar()
    means = rated.groupBy("price").agg(mean("rating").alias("mean_rating"))
    boxes = box_stats(rated, "rating", by=["price"])
    measures = ["q25", "q50", "q75", "whisker_low", "whisker_high"]
    return (
        means.join(boxes, "price").orderBy(F.col("mean_rating").desc(), "price")
        .select(
            "price", "count", half_up("mean_rating").alias("mean_rating"),
            half_up(overall).alias("overall_rating"),
            *[half_up(m, 4).alias(m) for m in measures], "outliers",
        )
    )


def top_chains(places: DataFrame, k: int = 15) -> DataFrame:
    """Chains with the most places and their mean rating."""
    chains = places.where((F.col("chain") == 1) & F.col("name").isNotNull())
    counted = chains.groupBy("name").agg(
        F.count("id").alias("count_points"),
        half_even(mean("rating")).alias("mean_rating"),
    )
    return top_k(counted, "count_points", k, ["name"])


def top_chain_categories(places: DataFrame, k: int = 15) -> DataFrame:
    """Categories of the places that belong to the largest chains."""
    chains = staged(places.where(F.col("chain") == 1).select(
        "id", "name", "chain", "category", "rating"), "chains")
    members = keep_ids(chains, top_chains(chains, k), "name")
    return members.where(F.col("category").isNotNull()).groupBy("category").agg(
        F.count("id").alias("places")
    )


def bill_summary(places: DataFrame, max_bill: int = MAX_BILL) -> DataFrame:
    """Distribution of bills and the number of implausible ones; one row."""
    bills = staged(places.select("middle_avg_bill"), "bills")
    bill = F.col("middle_avg_bill")
    odd = bills.agg(F.count_if((bill == 0) | (bill >= max_bill))).scalar()
    stats = describe(bills, "middle_avg_bill")
    measures = ["mean", "std", "var", "min", "q25", "q50", "q75", "max"]
    return stats.select("count", *[half_up(m, 4).alias(m) for m in measures]).withColumn(
        "implausible", odd
    )


def bill_by_district(places: DataFrame, max_bill: int = MAX_BILL) -> DataFrame:
    """Median bill and box-plot numbers per district, dearest district first."""
    bill = F.col("middle_avg_bill")
    kept = staged(
        places.where((bill != 0) & (bill < max_bill) & F.col("district").isNotNull())
        .select("district", "middle_avg_bill"),
        "district-bills",
    )
    boxes = box_stats(kept, "middle_avg_bill", by=["district"])
    measures = ["q25", "q75", "whisker_low", "whisker_high"]
    return (
        boxes.select(
            "district", "count", half_even("q50").alias("median_bill"),
            *[half_up(m, 4).alias(m) for m in measures], "outliers",
        )
        .orderBy(F.col("median_bill").desc(), "district")
    )


def bill_ranges(price: DataFrame) -> DataFrame:
    """Middle of the textual price ranges of bills and of coffee, per place."""
    return price.select(
        "id", "avg_bill",
        bill_middle("avg_bill", BILL_PREFIX).alias("parsed_bill"),
        bill_middle("avg_bill", COFFEE_PREFIX).alias("parsed_coffee_cup"),
    )
