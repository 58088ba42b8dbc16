"""Every analysis by name, bound to the local stand-in tables.

The parameters replace the constants of the original tables where the local ones
hold other names or dates.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyframe.operators import experiment, profile
from tallyframe.plans import abtest, game, handoff, hypothesis, library, places, realty
from tallyframe.sources.files import load
from tallyframe.sources.proxies import proxy
from tallyframe.sources.schemas import GAME_KEYS, STAR_KEYS

Query = Callable[[SparkSession, str], DataFrame]

CITIES = ("Moscow", "Saint Petersburg")
LISTENING_CITIES = ("AMERICA", "ASIA")
MAIN_CITY, TOWN_TYPE = "NATION_0", "building"
GAME_TABLES = tuple(GAME_KEYS)


def _on(plan: Callable, *views: str, **params) -> Query:
    """A query that calls ``plan`` with the named views."""

    def query(spark: SparkSession, directory: str) -> DataFrame:
        return plan(*[proxy(spark, directory, v) for v in views], **params)

    return query


def _on_game_tables(plan: Callable) -> Query:
    def query(spark: SparkSession, directory: str) -> DataFrame:
        tables = {t: proxy(spark, directory, f"g_{t}") for t in GAME_TABLES}
        return plan(tables, GAME_KEYS)

    return query


def _column_catalog(spark: SparkSession, directory: str) -> DataFrame:
    return game.column_catalog({t: load(spark, directory, t) for t in STAR_KEYS}, STAR_KEYS)


def _on_places(plan: Callable, priced: bool = False) -> Query:
    def query(spark: SparkSession, directory: str) -> DataFrame:
        info = proxy(spark, directory, "e_info")
        price = proxy(spark, directory, "e_price") if priced else None
        return plan(places.clean_places(info, price))

    return query


def _row_number_check(spark: SparkSession, directory: str) -> DataFrame:
    part = load(spark, directory, "part")
    return profile.index_column_check(part, "p_partkey")


def _quantity_is_line_number(spark: SparkSession, directory: str) -> DataFrame:
    lineitem = load(spark, directory, "lineitem")
    return profile.match_count(
        lineitem.select(F.floor("l_quantity").alias("a"), F.col("l_linenumber").alias("b")),
        "a", "b",
    )


def _clean_place_rows(places_df: DataFrame) -> DataFrame:
    return places_df.select(
        "id", "name", "address", "district", "category", "hours",
        F.col("rating").cast("double").alias("rating"), "chain", "seats", "price",
        F.col("middle_avg_bill").cast("double").alias("middle_avg_bill"), "is_hours", "is_24_7",
    )


def _one_name(places_df: DataFrame) -> DataFrame:
    return places.name_profile(places_df, "hot ring")


def _typed_ratings(info: DataFrame) -> DataFrame:
    return places.optimised_types(info).select(
        "id", F.col("rating").cast("double").alias("rating"), F.col("chain").cast("int").alias("chain")
    )


def _limits(flats: DataFrame, advertisement: DataFrame) -> DataFrame:
    limits = realty.outlier_limits(realty.staged_listings(flats, advertisement))
    return limits.select(*[F.col(c).cast("double").alias(c) for c in limits.columns])


def _priced(flats: DataFrame, advertisement: DataFrame) -> DataFrame:
    return realty.priced_listings(flats, advertisement).select(
        "id", F.col("price_1m").cast("double").alias("price_1m")
    )


def _preview(users: DataFrame) -> DataFrame:
    return game.table_preview(users)


def _incomplete(users: DataFrame) -> DataFrame:
    return game.incomplete_users(users).select("id", *game.USER_COLUMNS)


def _lifetime_rows(participants: DataFrame, events: DataFrame) -> DataFrame:
    return abtest.lifetime_events(participants, events).select(
        "user_id", "group", "event_name", "event_dt", "details", "reg_dt", "time_after_reg"
    )


def _registration_window(events: DataFrame) -> DataFrame:
    kept = experiment.within_lifetime(
        events, "user_id", F.col("event_name") == abtest.REGISTRATION, "event_dt", 7
    )
    return kept.groupBy("user_id", "reg_dt").agg(
        F.count("*").alias("events"), F.min("time_after_reg").alias("first_day"),
        F.max("time_after_reg").alias("last_day"),
    )


def _participants(participants: DataFrame) -> DataFrame:
    return abtest.clean_participants(participants).select("user_id", "group", "ab_test", "device")


X_TABLES = ("x_participants", "x_events")
LISTINGS = ("r_flats", "r_advertisement")
LIBRARY = ("l_audition", "l_content", "l_author")

QUERIES: dict[str, Query] = {
    # online game
    "table_overview": _on_game_tables(game.table_overview),
    "column_catalog": _column_catalog,
    "key_checks": _on_game_tables(game.key_checks),
    "reference_checks": _on_game_tables(game.reference_checks),
    "table_preview": _on(_preview, "g_users"),
    "null_audit": _on(game.null_audit, "g_users", "g_events"),
    "incomplete_users": _on(_incomplete, "g_users"),
    "category_counts": _on(game.category_counts, "g_users"),
    "payer_share": _on(game.payer_share, "g_users"),
    "payer_share_by_dim": _on(game.payer_share_by_dim, "g_users", "g_race"),
    "amount_stats": _on(game.amount_stats, "g_events"),
    "zero_purchases": _on(game.zero_purchases, "g_events"),
    "payer_vs_nonpayer": _on(game.payer_vs_nonpayer, "g_users", "g_events"),
    "item_popularity": _on(game.item_popularity, "g_events", "g_items"),
    "activity_by_dim": _on(game.activity_by_dim, "g_users", "g_events", "g_race"),
    "purchase_frequency_tiers": _on(
        game.purchase_frequency_tiers, "g_users", "g_events", min_events=5
    ),
    # online library
    "rejected_dates": _on(library.rejected_dates, "l_audition"),
    "mau_top_authors": _on(library.mau_top_authors, *LIBRARY),
    "mau_top_titles": _on(library.mau_top_titles, *LIBRARY),
    "daily_retention": _on(library.daily_retention, "l_daily", base_day="2024-01-21"),
    "ltv_by_city": _on(library.ltv_by_city, "l_audition", "l_geo", cities=LISTENING_CITIES),
    "revenue_per_hour": _on(library.revenue_per_hour, "l_audition"),
    # real estate
    "price_per_area": _on(_priced, *LISTINGS),
    "outlier_limits": _on(_limits, *LISTINGS),
    "time_on_market_segments": _on(
        realty.time_on_market_segments, *LISTINGS, "r_city", "r_type",
        main_city=MAIN_CITY, town_type=TOWN_TYPE,
    ),
    "seasonality": _on(
        realty.seasonality, *LISTINGS, "r_type",
        town_type=TOWN_TYPE, opened=(1996, 1999), closed=(1998, 1999),
    ),
    "top_towns": _on(realty.top_towns, *LISTINGS, "r_city", main_city=MAIN_CITY),
    "market_overview": _on(realty.market_overview, "r_flats"),
    "listing_dynamics": _on(realty.listing_dynamics, "r_advertisement"),
    "town_price_per_area": _on(realty.town_price_per_area, *LISTINGS, "r_city"),
    "top_towns_by_measure": _on(realty.top_towns_by_measure, *LISTINGS, "r_city"),
    # two-city comparison
    "row_number_check": _row_number_check,
    "column_match": _quantity_is_line_number,
    "group_integrity": _on(hypothesis.group_integrity, "h_sample", cities=CITIES),
    "city_shares": _on(hypothesis.city_shares, "h_sample"),
    "group_moments": _on(hypothesis.group_moments, "h_sample"),
    "hours_box": _on(hypothesis.hours_box, "h_sample"),
    "variance_test": _on(hypothesis.variance_test, "h_sample", cities=CITIES),
    "value_histogram": _on(hypothesis.value_histogram, "h_sample"),
    "mean_test": _on(hypothesis.mean_test, "h_sample", cities=CITIES),
    # store experiment
    "experiment_overview": _on(abtest.experiment_overview, *X_TABLES),
    "category_values": _on(abtest.category_values, "x_participants"),
    "assignment_check": _on(abtest.assignment_check, "x_participants"),
    "assignment_shares": _on(abtest.assignment_shares, "x_participants"),
    "clean_participants": _on(_participants, "x_participants"),
    "participant_counts": _on(abtest.participant_counts, *X_TABLES),
    "event_names": _on(abtest.event_names, *X_TABLES),
    "lifetime_events": _on(_lifetime_rows, *X_TABLES),
    "registration_window": _on(_registration_window, "x_events"),
    "lifetime_summary": _on(abtest.lifetime_summary, *X_TABLES),
    "power_check": _on(abtest.power_check, *X_TABLES),
    "conversion_by_group": _on(abtest.conversion_by_group, *X_TABLES),
    "conversion_difference": _on(abtest.conversion_difference, *X_TABLES),
    "conversion_test": _on(abtest.conversion_test, *X_TABLES),
    "zone_activity": _on(abtest.zone_activity, "x_events"),
    "money_by_group": _on(abtest.money_by_group, *X_TABLES),
    # restaurants
    "dataset_profile": _on(places.dataset_profile, "e_info", "e_price"),
    "merge_price": _on(places.merge_price, "e_info", "e_price"),
    "optimised_types": _on(_typed_ratings, "e_info"),
    "missingness_by_dim": _on(places.missingness_by_dim, "e_info"),
    "duplicate_places": _on(places.duplicate_places, "e_info"),
    "clean_places": _on_places(_clean_place_rows, priced=True),
    "category_distribution": _on_places(places.category_distribution),
    "name_counts": _on_places(places.name_counts),
    "name_profile": _on_places(_one_name),
    "place_values": _on_places(places.place_values, priced=True),
    "chain_share": _on_places(places.chain_share),
    "seats_summary": _on_places(places.seats_summary),
    "seats_box": _on_places(places.seats_box),
    "typical_seats": _on_places(places.typical_seats),
    "rating_summary": _on_places(places.rating_summary),
    "rating_histogram": _on_places(places.rating_histogram),
    "rating_by_category": _on_places(places.rating_by_category),
    "rating_chi_square": _on_places(places.rating_chi_square, priced=True),
    "rating_association": _on_places(places.rating_association, priced=True),
    "rating_by_price": _on_places(places.rating_by_price, priced=True),
    "top_chains": _on_places(places.top_chains),
    "top_chain_categories": _on_places(places.top_chain_categories),
    "bill_summary": _on_places(places.bill_summary, priced=True),
    "bill_by_district": _on_places(places.bill_by_district, priced=True),
    "bill_ranges": _on(places.bill_ranges, "e_price"),
    # file round trips
    "event_files": _on(handoff.event_files, "x_events"),
    "sample_files": _on(handoff.quoted_files, "h_sample", schema_name="online_library_data"),
    "participant_files": _on(
        handoff.quoted_files, "x_participants", schema_name="ab_test_participants"
    ),
    "place_files": _on(handoff.quoted_files, "e_info", schema_name="ctr_info"),
    "price_files": _on(handoff.quoted_files, "e_price", schema_name="ctr_price"),
    "city_handoff": _on(handoff.city_handoff, "l_audition", "l_geo"),
    "user_handoff": _on(handoff.user_handoff, "l_audition", "l_geo"),
    "month_handoff": _on(
        handoff.month_handoff, "l_audition", first_month="1997-09-01", last_month="1997-11-01"
    ),
}
