"""File round trips: CSV scans under a declared schema, partitioned hand-over."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyframe.functions.numeric import total
from tallyframe.functions.temporal import month_start
from tallyframe.functions.text import numeric_details
from tallyframe.plans.library import with_day
from tallyframe.sources.files import (
    read_bucketed, read_csv, read_dataset, write_bucketed, write_dataset,
)
from tallyframe.sources.schemas import csv_schema
from tallyframe.sources.staging import shared_folder


def _fresh_path(spark: SparkSession, label: str) -> str:
    app = spark.sparkContext.applicationId
    return f"{shared_folder(spark)}/{app}/{label}-{uuid.uuid4().hex}"


def event_files(events: DataFrame) -> DataFrame:
    """Events written as CSV, scanned again with typed columns, summed by type."""
    spark = events.sparkSession
    path = _fresh_path(spark, "events-csv")
    pattern = "yyyy-MM-dd HH:mm:ss"
    schema = csv_schema("ab_test_events")
    (
        events.select(*schema.fieldNames()).write.option("header", True)
        .option("timestampNTZFormat", pattern).csv(path)
    )
    scanned = read_csv(spark, path, schema, pattern)
    return scanned.groupBy("event_name").agg(
        F.count("*").alias("events"),
        F.min("event_dt").cast("string").alias("first_event"),
        F.max("event_dt").cast("string").alias("last_event"),
        F.count(numeric_details("details")).alias("numeric_details"),
        F.sum(numeric_details("details")).cast("double").alias("amount"),
    )


# Appended to every text: what a careless CSV reader stumbles over.
AWKWARD = ', "x"\n"y'


def quoted_files(rows: DataFrame, schema_name: str) -> DataFrame:
    """A table written as CSV with quotes, commas and line breaks in every text, scanned again.

    Columns that the declared schema has and the table lacks are written empty.
    One row per text column: rows, texts, their characters and those that came
    back whole.
    """
    spark = rows.sparkSession
    path = _fresh_path(spark, schema_name)
    schema = csv_schema(schema_name)
    texts = [f.name for f in schema.fields if f.dataType.typeName() == "string"]
    typed = rows.select(*[
        (F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in schema.fields
    ])
    awkward = typed.withColumns({c: F.concat(F.col(c), F.lit(AWKWARD)) for c in texts})
    (
        awkward.write.option("header", True).option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    )
    scanned = read_csv(spark, path, schema)
    return scanned.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(c).alias("text")) for c in texts
    ]))).groupBy("column_name").agg(
        F.count("*").alias("rows"), F.count("text").alias("texts"),
        F.sum(F.length("text")).alias("chars"),
        F.count_if(F.col("text").endswith(AWKWARD)).alias("whole"),
    )


def user_city_hours(audition: DataFrame, geo: DataFrame) -> DataFrame:
    """Hours per user and city: the prepared table the two-city comparison starts from."""
    per_geo = audition.groupBy("usage_geo_id", "puid").agg(total("hours").alias("hours"))
    return per_geo.join(geo, "usage_geo_id").select(
        F.col("usage_geo_id_name").alias("city"), "puid", "hours"
    )


def city_handoff(audition: DataFrame, geo: DataFrame) -> DataFrame:
    """The prepared table written as Parquet by city and read back, per city."""
    spark = audition.sparkSession
    path = _fresh_path(spark, "city-hours")
    write_dataset(user_city_hours(audition, geo), path, ["city"])
    return read_dataset(spark, path).groupBy("city").agg(
        F.count("*").alias("users"), total("hours").alias("hours")
    )


def user_handoff(audition: DataFrame, geo: DataFrame) -> DataFrame:
    """The prepared table written in buckets of users; the next study joins it where it lies.

    Per city: users, their hours there and their days with any listening.  Only
    the days, already one row per user, move to the buckets.
    """
    spark = audition.sparkSession
    path, prepared = _fresh_path(spark, "user-hours"), user_city_hours(audition, geo)
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    write_bucketed(prepared, path, "puid", buckets)
    handed = read_bucketed(spark, path, prepared.schema, "puid", buckets)
    days = with_day(audition).where("day IS NOT NULL").select("puid", "day").distinct().groupBy(
        "puid"
    ).agg(F.count("*").alias("active_days"))
    return handed.join(days, "puid", "left").groupBy("city").agg(
        F.count("*").alias("users"), total("hours").alias("hours"),
        F.coalesce(F.sum("active_days"), F.lit(0)).alias("active_days"),
    )


def month_handoff(audition: DataFrame, first_month: str, last_month: str) -> DataFrame:
    """Listening rows written by month; only the asked months are read back."""
    spark = audition.sparkSession
    path = _fresh_path(spark, "audition-months")
    monthly = with_day(audition).withColumn("month", month_start("day"))
    write_dataset(monthly.select("puid", "hours", "month"), path, ["month"])
    asked = read_dataset(spark, path).where(F.col("month").between(first_month, last_month))
    return asked.groupBy("month").agg(
        F.count("*").alias("rows"), F.sum("hours").cast("double").alias("hours")
    )
