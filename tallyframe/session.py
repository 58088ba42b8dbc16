"""Session settings the analyses are written for."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Adaptive execution sizes the shuffles and splits skewed join partitions; the
# zone makes text and clock conversions the same everywhere.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.files.maxPartitionBytes": "256m",
    "spark.sql.session.timeZone": "UTC",
}


def configure(builder: SparkSession.Builder) -> SparkSession.Builder:
    """Add the settings to a session builder.

    A cluster also names a shared folder in ``spark.checkpoint.dir`` and enough
    initial shuffle partitions in ``spark.sql.shuffle.partitions``.
    """
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    return builder
