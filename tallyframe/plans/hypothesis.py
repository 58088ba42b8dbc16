"""Two-city comparison of reading hours."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tallyframe.functions.numeric import half_up
from tallyframe.operators.clean import drop_ambiguous
from tallyframe.operators.experiment import group_imbalance, group_shares, with_decision
from tallyframe.operators.joins import overlap
from tallyframe.operators.profile import describe, duplicate_count
from tallyframe.operators.stats import box_stats, histogram, levene, welch_ttest
from tallyframe.sources.staging import staged

# The compared cities.
CITIES = ("Москва", "Санкт-Петербург")


def clean_sample(sample: DataFrame) -> DataFrame:
    """Only users that belong to one city."""
    return drop_ambiguous(sample, "puid")


def staged_sample(sample: DataFrame) -> DataFrame:
    """The cleaned sample, written once for reports that read it repeatedly."""
    return staged(clean_sample(sample).select("city", "puid", "hours"), "sample")


def group_integrity(sample: DataFrame, cities: tuple[str, str] = CITIES) -> DataFrame:
    """Duplicates, overlap of the cities, and the sizes after ambiguous users left."""
    first, second = cities
    clean = staged_sample(sample)

    def entries(row: DataFrame, **names: str) -> DataFrame:
        return row.select(F.inline(F.array(*[
            F.struct(F.lit(label).alias("measure"), F.col(c).cast("double").alias("value"))
            for label, c in names.items()
        ])))

    sizes = group_imbalance(clean, "city", "puid", first, second).withColumn(
        "imbalance", half_up("imbalance")
    )
    parts = [
        entries(duplicate_count(sample, ["puid"]), rows="row_count", duplicate_ids="duplicates"),
        entries(
            overlap(sample, "puid", F.col("city") == first, F.col("city") == second),
            only_first="only_a", only_second="only_b", in_both="both",
        ),
        entries(duplicate_count(clean), clean_rows="row_count", full_duplicates="duplicates"),
        entries(duplicate_count(clean, ["puid"]), duplicate_ids_left="duplicates"),
        entries(
            sizes, first_users="control_users", second_users="test_users", imbalance="imbalance"
        ),
    ]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def city_shares(sample: DataFrame) -> DataFrame:
    """Users per city and their percent."""
    return group_shares(clean_sample(sample), "city", "puid").withColumn("share", half_up("share"))


def group_moments(sample: DataFrame) -> DataFrame:
    """Distribution of hours per city."""
    stats = describe(staged_sample(sample), "hours", by=["city"])
    measures = ["mean", "std", "var", "min", "q25", "q50", "q75", "max"]
    return stats.select("city", "count", *[half_up(m, 4).alias(m) for m in measures])


def hours_box(sample: DataFrame) -> DataFrame:
    """Quartiles, whiskers and outliers of hours per city."""
    stats = box_stats(staged_sample(sample), "hours", by=["city"])
    measures = ["q25", "q50", "q75", "whisker_low", "whisker_high"]
    return stats.select("city", "count", *[half_up(m, 4).alias(m) for m in measures], "outliers")


def variance_test(
    sample: DataFrame, cities: tuple[str, str] = CITIES, alpha: float = 0.05
) -> DataFrame:
    """Equality of the variances of hours."""
    test = with_decision(
        levene(staged_sample(sample), "city", "hours", cities), "p_value", alpha
    )
    return test.withColumns({"f_stat": half_up("f_stat", 6), "p_value": half_up("p_value", 6)})


def value_histogram(sample: DataFrame, bins: int = 37) -> DataFrame:
    """Density histogram of hours per city, each over its own range."""
    return histogram(staged_sample(sample), "hours", bins, by=["city"])


def mean_test(
    sample: DataFrame, cities: tuple[str, str] = CITIES, alpha: float = 0.05
) -> DataFrame:
    """Whether the first city's mean of hours is smaller."""
    test = with_decision(
        welch_ttest(clean_sample(sample), "city", "hours", *cities, alternative="smaller"),
        "p_value", alpha,
    )
    rounded = ["mean_a", "var_a", "mean_b", "var_b", "t_stat", "dof", "p_value"]
    return test.withColumns({
        c: half_up(c, 2 if c.startswith("var") else 5) for c in rounded
    })
