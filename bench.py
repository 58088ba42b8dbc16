"""Time every analysis on warm data and print one JSON line.

Each query runs once to warm up and then ``BENCH_RUNS`` times; the median counts.
Cached and written intermediate results are dropped between runs, so a run never
profits from an earlier one.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time
from pathlib import Path

from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent))

from tallyframe.plans.registry import QUERIES  # noqa: E402
from tallyframe.session import configure  # noqa: E402
from tallyframe.sources.staging import release  # noqa: E402

HEADLINE = (
    "payer_share_by_dim", "amount_stats", "payer_vs_nonpayer", "item_popularity",
    "activity_by_dim", "purchase_frequency_tiers",
    "mau_top_authors", "mau_top_titles", "daily_retention", "ltv_by_city", "revenue_per_hour",
    "time_on_market_segments", "seasonality", "top_towns",
    "group_integrity", "group_moments", "variance_test", "value_histogram", "mean_test",
    "experiment_overview", "assignment_check", "lifetime_events", "conversion_by_group",
    "conversion_test",
    "clean_places", "category_distribution", "typical_seats", "rating_by_category",
    "rating_association", "top_chains", "bill_by_district",
)


def main() -> None:
    directory = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "5"))
    spark = (
        configure(SparkSession.builder).master(f"local[{cpus}]").appName("tallyframe-bench")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .config("spark.checkpoint.dir", os.environ.get("BENCH_SHARED_DIR") or tempfile.mkdtemp())
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}
    for name in HEADLINE:
        samples = []
        for _ in range(runs + 1):
            spark.catalog.clearCache()
            start = time.perf_counter()
            QUERIES[name](spark, directory).collect()
            samples.append(time.perf_counter() - start)
            release(spark)
        times[name] = round(statistics.median(samples[1:]), 3)
    print(json.dumps({
        "metric": "total_median_seconds", "value": round(sum(times.values()), 3),
        "unit": "sec", "queries": times, "sf": Path(directory).name,
    }))


if __name__ == "__main__":
    main()
