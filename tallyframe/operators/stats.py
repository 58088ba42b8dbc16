"""Tests and distribution summaries built on distributed aggregates.

Rows are reduced to counts, moments or bins by Spark; the closing formula works
on the one row per test or per group that is left.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tallyframe.functions.numeric import known, quotient
from tallyframe.functions.special import f_p, normal_p, student_p
from tallyframe.operators.joins import null_safe_join
from tallyframe.operators.ranking import Cells, percentile_ranks, picked_percentiles
from tallyframe.sources.staging import staged


def _moments(group: str, value: str, key, prefix: str) -> list[Column]:
    x = F.when(F.col(group) == F.lit(key), known(value).cast("double"))
    return [
        F.count(x).alias(f"n_{prefix}"),
        F.avg(x).alias(f"mean_{prefix}"),
        F.var_samp(x).alias(f"var_{prefix}"),
    ]


def welch_from_moments(row: DataFrame, alternative: str) -> DataFrame:
    """Welch's t, Satterthwaite degrees of freedom and p from counts, means, variances."""
    error_a, error_b = quotient("var_a", "n_a"), quotient("var_b", "n_b")
    return (
        row.withColumn("t_stat", quotient(
            F.col("mean_a") - F.col("mean_b"), F.sqrt(error_a + error_b)))
        .withColumn("dof", quotient(
            F.pow(error_a + error_b, 2),
            quotient(F.pow(error_a, 2), F.col("n_a") - 1)
            + quotient(F.pow(error_b, 2), F.col("n_b") - 1)))
        .withColumn("p_value", student_p(F.col("t_stat"), F.col("dof"), alternative))
    )


def welch_ttest(
    df: DataFrame, group: str, value: str, a, b, alternative: str = "two-sided"
) -> DataFrame:
    """Compare two group means without assuming equal variances; one row."""
    row = df.agg(*_moments(group, value, a, "a"), *_moments(group, value, b, "b"))
    return welch_from_moments(row, alternative)


def proportions_ztest(
    df: DataFrame, group: str, total: str, hits: str, control, test, alternative: str = "two-sided"
) -> DataFrame:
    """Compare two proportions with pooled variance; one row from per-group counts."""

    def of(key, column: str) -> Column:
        return F.max(F.when(F.col(group) == F.lit(key), F.col(column)))

    row = df.agg(
        of(control, total).alias("n_a"), of(control, hits).alias("hits_a"),
        of(test, total).alias("n_b"), of(test, hits).alias("hits_b"),
    )
    pooled = quotient(F.col("hits_a") + F.col("hits_b"), F.col("n_a") + F.col("n_b"))
    spread = F.sqrt(
        pooled * (1 - pooled) * (quotient(F.lit(1), F.col("n_a")) + quotient(F.lit(1), F.col("n_b")))
    )
    difference = quotient("hits_a", "n_a") - quotient("hits_b", "n_b")
    return row.withColumn("z_stat", quotient(difference, spread)).withColumn(
        "p_value", normal_p(F.col("z_stat"), alternative)
    )


def levene(df: DataFrame, group: str, value: str, groups: Sequence) -> DataFrame:
    """Equality of variances by absolute distances from the group medians; one row.

    Two scans.  The first takes count, mean and squared deviations per grid cell;
    the second reads the cells of the medians.  All other cells lie wholly on one
    side of their group's median, so the distances of a cell's rows have its
    squared deviations and the distance of its mean.  Cells are merged with their
    means taken from the group's mean distance, so nothing cancels.
    """
    rows = df.where(F.col(group).isin(list(groups))).select(
        F.col(group).alias("g"), F.col(value).cast("double").alias("x")
    )
    also = {"m": F.avg("v"), "s": F.var_pop("v") * F.count("v")}
    specs = {"centre": ("x", "0.5")}
    cells = Cells(rows, {"x": "x"}, percentile_ranks(["0.5"], True), ["g"], also=also)
    # One row per named group.
    centres = staged(picked_percentiles(cells.located(), specs, ["g"], True), "centres")
    parts = cells.unread().select("g", "n", "m", "s").unionByName(
        cells.values.select("g", "n", F.col("v").alias("m"), F.lit(0.0).alias("s"))
    )
    distances = parts.join(centres, "g").withColumn("z", F.abs(F.col("m") - F.col("centre")))
    means = staged(
        distances.groupBy("g").agg(
            F.sum("n").alias("total"), quotient(F.sum(F.col("n") * F.col("z")), F.sum("n")).alias("mean")
        ), "mean-distances",
    )
    per_group = distances.join(means, "g").groupBy("g").agg(
        F.max("total").alias("n"), F.max("mean").alias("m"),
        F.sum(F.col("s") + F.col("n") * F.pow(F.col("z") - F.col("mean"), F.lit(2))).alias("within"),
    )
    sums = per_group.agg(
        F.sum("n").alias("n_total"),
        F.count("*").alias("k"),
        quotient(F.sum(F.col("n") * F.col("m")), F.sum("n")).alias("mean"),
        F.collect_list(F.struct("n", "m")).alias("groups"),
        F.sum("within").alias("within"),
    )
    between = F.aggregate(
        "groups", F.lit(0.0), lambda s, g: s + g["n"] * F.pow(g["m"] - F.col("mean"), F.lit(2))
    )
    return (
        sums.withColumn("dof_between", F.col("k") - 1)
        .withColumn("dof_within", F.col("n_total") - F.col("k"))
        .withColumn("f_stat", quotient(
            quotient(between, "dof_between"), quotient("within", "dof_within")))
        .withColumn("p_value", f_p(
            F.col("f_stat"), F.col("dof_between").cast("double"),
            F.col("dof_within").cast("double")))
        .select("n_total", "dof_between", "dof_within", "f_stat", "p_value")
    )


def histogram(df: DataFrame, value: str, bins: int, by: Sequence[str] = ()) -> DataFrame:
    """Equal-width bins over the value range, the last one closed on both sides.

    Missing values and not-a-number do not count.  Each group is binned over its
    own range.  Empty bins are listed with zero.
    ``density`` is the count over total and width, so that the area is one.
    """
    by = list(by)
    rows = df.where(known(value).isNotNull()).select(*by, F.col(value).cast("double").alias("x"))
    ranges = staged(
        rows.groupBy(*by).agg(F.min("x").alias("mn"), F.max("x").alias("mx"), F.count("*").alias("n"))
        .where(F.col("n") > 0)
        .select(
            *by, "n",
            # A single value is placed in the middle of a range of width one.
            F.when(F.col("mn") == F.col("mx"), F.col("mn") - 0.5).otherwise(F.col("mn")).alias("lo"),
            F.when(F.col("mn") == F.col("mx"), F.col("mx") + 0.5).otherwise(F.col("mx")).alias("hi"),
        ), "ranges",
    )
    step = (F.col("hi") - F.col("lo")) / F.lit(bins)

    def edge(i: Column) -> Column:
        return F.when(i == bins, F.col("hi")).otherwise(F.col("lo") + i * step)

    guess = F.least(
        F.floor((F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1)
    )
    if by:
        placed = null_safe_join(rows, ranges, by)
    else:
        row = ranges.select(F.struct("lo", "hi", "n")).scalar()
        placed = rows.withColumns({"lo": row["lo"], "hi": row["hi"]})
    # The edges decide where rounding put a value on the wrong side of one.
    counted = (
        placed.withColumn("i", guess)
        .withColumn("i", F.col("i")
                    - F.when(F.col("x") < edge(F.col("i")), 1).otherwise(0)
                    + F.when((F.col("i") < bins - 1) & (F.col("x") >= edge(F.col("i") + 1)), 1)
                    .otherwise(0))
        .groupBy(*by, F.col("i").alias("bin")).agg(F.count("*").alias("count"))
    )
    frame = ranges.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1)).cast("array<bigint>")))
    filled = null_safe_join(frame, counted, [*by, "bin"], "left")
    return filled.select(
        *by, "bin",
        edge(F.col("bin")).alias("left_edge"), edge(F.col("bin") + 1).alias("right_edge"),
        F.coalesce("count", F.lit(0)).alias("count"),
        quotient(F.coalesce("count", F.lit(0)), F.col("n") * step).alias("density"),
    )


REACH = 1.5  # interquartile ranges from the box to the farthest whisker


def _fence_cells(ranked: DataFrame, key: Sequence[str]) -> DataFrame:
    """Marks the cells that a fence can cut, from the edges of the quartiles' cells."""

    def holds(q: str) -> Column:
        return F.exists("want", lambda r: r["label"].startswith(f"{q}:"))

    edges = ranked.groupBy(*key).agg(*[
        pick(F.when(holds(q), F.col(edge))).alias(f"{name}_{edge}")
        for name, q in (("q25", "0.25"), ("q75", "0.75"))
        for pick, edge in ((F.min, "low"), (F.max, "high"))
    ])
    widest, narrowest = F.col("q75_high") - F.col("q25_low"), F.col("q75_low") - F.col("q25_high")
    slack = 1e-9 * (F.abs("q25_low") + F.abs("q75_high"))  # for the rounding of the bounds
    bounds = edges.select(
        *key,
        (F.col("q25_low") - REACH * widest - slack).alias("under_from"),
        (F.col("q25_high") - REACH * narrowest + slack).alias("under_to"),
        (F.col("q75_low") + REACH * narrowest - slack).alias("over_from"),
        (F.col("q75_high") + REACH * widest + slack).alias("over_to"),
    )

    def cut(start: str, end: str) -> Column:
        return (F.col("high") >= F.col(start)) & (F.col("low") <= F.col(end))

    return null_safe_join(ranked, staged(bounds, "fence-bounds"), key).withColumn(
        "more", cut("under_from", "under_to") | cut("over_from", "over_to")
    )


def box_stats(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Quartiles, whiskers at 1.5 interquartile ranges and the rows beyond them.

    Two scans: counts per grid cell, then the values of the cells that hold a
    quartile or that a fence can cut.  Other cells lie inside or beyond as a whole.
    """
    by = list(by)
    rows = df.select(*by, F.col(value).cast("double").alias("x"))
    names = {"q25": "0.25", "q50": "0.5", "q75": "0.75"}
    cells = Cells(
        rows, {"x": "x"}, percentile_ranks(list(names.values()), True), by, also={}, more=_fence_cells
    )
    quartiles = staged(
        picked_percentiles(cells.located(), {o: ("x", p) for o, p in names.items()}, by, True), "quartiles"
    )
    parts = cells.unread().select(*by, "n", "low", "high").unionByName(
        cells.values.select(*by, "n", F.col("v").alias("low"), F.col("v").alias("high"))
    )
    if by:
        placed = null_safe_join(parts, quartiles, by)
    else:
        row = quartiles.select(F.struct(*names)).scalar()
        placed = parts.withColumns({o: row[o] for o in names})
    reach = (F.col("q75") - F.col("q25")) * REACH
    inside = (F.col("low") >= F.col("q25") - reach) & (F.col("high") <= F.col("q75") + reach)
    return placed.groupBy(*by).agg(
        F.sum("n").alias("count"),
        *[F.max(o).alias(o) for o in names],
        F.min(F.when(inside, F.col("low"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("high"))).alias("whisker_high"),
        F.coalesce(F.sum(F.when(~inside, F.col("n"))), F.lit(0)).alias("outliers"),
    )
