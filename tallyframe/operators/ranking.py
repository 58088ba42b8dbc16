"""Exact order statistics, tiers, ranks and top-k without a global sort.

The built-in exact percentiles hold every distinct value of a group in one
buffer, and a window without PARTITION BY moves the whole table to one task.
Both fail on large inputs.  Here an order statistic is found by counting:

1. every row falls into a cell of a fixed logarithmic grid; the counts per cell
   are pre-aggregated on the map side, and their running sum names the one cell
   that holds the wanted rank;
2. only the rows of that cell are read again and counted per distinct value; a
   crowded cell is first split linearly between its smallest and largest value;
3. the wanted value is picked by a running sum inside one cell or slice.

The grid depends on the value alone, so any re-execution of a lost task gives
the same cells.  Nothing is sampled and nothing is approximate.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyframe.operators.joins import null_safe_join
from tallyframe.sources.staging import staged

CELLS_PER_E_FOLD = 2048
SLICES = 65536
# exp(-745) is the smallest positive double, so every logarithm stays above it.
_LOG_FLOOR = 746
_LARGEST = 1.7976931348623157e308


def _cell(value: Column) -> Column:
    """Index of the logarithmic grid cell; never decreases with the value."""
    double = value.cast("double")
    magnitude = (
        F.floor(F.ln(F.least(F.abs(double), F.lit(_LARGEST))) * CELLS_PER_E_FOLD)
        + _LOG_FLOOR * CELLS_PER_E_FOLD
    )
    return F.when(double > 0, magnitude).when(double < 0, -magnitude).otherwise(F.lit(0))


class Cells:
    """Rows of some measures counted per grid cell, and the distinct values of a few cells.

    The first scan writes a row per non-empty cell: ``n``, ``low``, ``high`` and
    what ``also`` names, mergeable figures such as moments.  The second one reads
    only the cells that hold a wanted rank, or that ``more`` names, and writes
    their distinct values with their counts.  Whatever is asked of a group is then
    answered from these two tables: a cell counts as a whole, or by its values.

    Missing values and not-a-number do not count.
    """

    def __init__(
        self, df: DataFrame, values: Mapping[str, str], ranks, by: Sequence[str] = (),
        also: Mapping[str, Column] | None = None, more=None,
    ):
        self.by, self.key = list(by), [*by, "measure"]
        measures = df.select(*by, *[F.col(c).alias(m) for m, c in values.items()])
        rows = measures.unpivot(self.by, list(values), "measure", "v")
        present = F.col("v").isNotNull() & ~F.isnan(F.col("v").cast("double"))
        rows = rows.where(present).withColumn("cell", _cell(F.col("v")))
        cells = rows.groupBy(*self.key, "cell").agg(
            F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"),
            *[c.alias(name) for name, c in (also or {}).items()],
        )
        # Written where it is read again: to find ranks, and to answer the rest.
        self.cells = staged(cells, "cells") if also is not None or more is not None else cells
        group = Window.partitionBy(*self.key)
        until = group.orderBy("cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        ranked = (
            self.cells.withColumn("total", F.sum("n").over(group))
            .withColumn("last", F.sum("n").over(until))
            .withColumn("first", F.col("last") - F.col("n"))
            .withColumn("want", F.filter(
                ranks(F.col("total")),
                lambda r: (r["rank"] > F.col("first")) & (r["rank"] <= F.col("last")),
            ))
        )
        if more is not None:
            ranked = staged(ranked, "ranked-cells")
        asked = F.size("want") > 0
        kept = ranked.where(asked) if more is None else more(ranked, self.key).where(asked | F.col("more"))
        # Written, so that the planner knows the true size of this side: it is
        # broadcast below the configured threshold and shuffled above it.
        self.wanted = staged(
            kept.select(*self.key, "cell", "total", "first", "low", "high", "want"), "wanted-cells"
        )
        hits = _distinct(null_safe_join(rows, self.wanted, [*self.key, "cell"]), self.key)
        self.values = staged(hits, "cell-values") if also is not None or more is not None else hits

    def located(self) -> DataFrame:
        """The wanted ranks: group columns, ``measure``, ``total``, ``label``, ``rank``, ``value``, ``below``."""
        hits, part, base = _sliced(self.values.where(F.size("want") > 0), self.key)
        within = (
            Window.partitionBy(*part).orderBy("v")
            .rowsBetween(Window.unboundedPreceding, Window.currentRow)
        )
        found = (
            hits.withColumn("last", base + F.sum("n").over(within))
            .withColumn("below", F.col("last") - F.col("n"))
            .withColumn("want", F.filter(
                "want", lambda r: (r["rank"] > F.col("below")) & (r["rank"] <= F.col("last"))
            ))
        )
        return found.select(
            *self.key, "total", F.explode("want").alias("w"), F.col("v").alias("value"), "below"
        ).select(
            *self.key, "total", F.col("w.label").alias("label"), F.col("w.rank").alias("rank"),
            "value", "below",
        )

    def unread(self) -> DataFrame:
        """The cells whose values were not read."""
        return null_safe_join(
            self.cells, self.wanted.select(*self.key, "cell"), [*self.key, "cell"], "left_anti"
        )


def order_statistics(
    df: DataFrame,
    values: Mapping[str, str],
    ranks,
    by: Sequence[str] = (),
) -> DataFrame:
    """The values that stand at given ranks, per group and measure.

    ``values`` maps a measure name to a numeric column; missing values and
    not-a-number do not count.  ``ranks`` takes the column holding a group's row count and returns an
    array column of structs ``(label, rank)`` with 1-based ranks.  The result has
    the group columns, ``measure``, ``total`` (the group's row count), ``label``,
    ``rank``, ``value`` and ``below``, the number of rows whose value is smaller.
    """
    return Cells(df, values, ranks, by).located()


def _distinct(rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """Distinct values of the cells with their counts and the slice of the cell they lie in."""
    slice_of = F.when(
        F.col("high") > F.col("low"),
        F.floor(
            (F.col("v") - F.col("low")).cast("double")
            / (F.col("high") - F.col("low")).cast("double") * SLICES
        ),
    ).otherwise(F.lit(0))
    return rows.groupBy(
        *key, "cell", "total", "first", "want", slice_of.alias("slice"), "v"
    ).agg(F.count("*").alias("n"))


def _sliced(hits: DataFrame, key: Sequence[str]):
    """Values of crowded cells with what lies before their slice, which one task can sort."""
    before = (
        Window.partitionBy(*key, "cell").orderBy("slice")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    slices = (
        hits.groupBy(*key, "cell", "slice").agg(F.sum("n").alias("slice_n"))
        .withColumn("before", F.coalesce(F.sum("slice_n").over(before), F.lit(0)))
        .drop("slice_n")
    )
    part = [*key, "cell", "slice"]
    return null_safe_join(hits, slices, part), part, F.col("first") + F.col("before")


def _rank_struct(label: str, rank: Column) -> Column:
    return F.struct(F.lit(label).alias("label"), rank.cast("bigint").alias("rank"))


def percentiles(
    df: DataFrame,
    specs: Mapping[str, tuple[str, str | float]],
    by: Sequence[str] = (),
    interpolate: bool = False,
) -> DataFrame:
    """Exact percentiles, one output column per entry and one row per group.

    ``specs`` maps an output name to ``(column, fraction)``.  By default the
    result is an existing value, the first whose share of rows reaches the
    fraction; with ``interpolate`` it lies linearly between two neighbours.
    Groups without any value are absent from the result.
    """
    measures = {c: c for c in dict.fromkeys(c for c, _ in specs.values())}
    ranks = percentile_ranks([p for _, p in specs.values()], interpolate)
    return picked_percentiles(order_statistics(df, measures, ranks, by), specs, by, interpolate)


def percentile_ranks(fractions: Sequence[str | float], interpolate: bool):
    """The ranks that percentiles of a group of n rows are taken from."""

    def ranks(n: Column) -> Column:
        wanted = []
        for p in dict.fromkeys(Decimal(str(p)) for p in fractions):
            if interpolate:
                low = F.floor((n - 1) * F.lit(p)) + 1
                wanted.append(_rank_struct(f"{p}:low", low))
                wanted.append(_rank_struct(f"{p}:high", F.least(low + 1, n)))
            else:
                wanted.append(_rank_struct(f"{p}", F.greatest(F.ceil(n * F.lit(p)), F.lit(1))))
        return F.array(*wanted)

    return ranks


def picked_percentiles(
    found: DataFrame, specs: Mapping[str, tuple[str, str | float]], by: Sequence[str], interpolate: bool,
) -> DataFrame:
    """One row per group from the values at ``percentile_ranks``."""
    by = list(by)
    fractions = {name: Decimal(str(p)) for name, (_, p) in specs.items()}
    column_of = {name: c for name, (c, _) in specs.items()}

    def picked(name: str, label: str, column: str = "value") -> Column:
        at = (F.col("measure") == column_of[name]) & (F.col("label") == label)
        return F.max(F.when(at, F.col(column)))

    if not interpolate:
        return found.groupBy(*by).agg(
            *[picked(n, f"{fractions[n]}").alias(n) for n in specs]
        )

    def blended(name: str) -> Column:
        low = picked(name, f"{fractions[name]}:low").cast("double")
        high = picked(name, f"{fractions[name]}:high").cast("double")
        position = (picked(name, f"{fractions[name]}:low", "total") - 1) * F.lit(fractions[name])
        part = (position - F.floor(position)).cast("double")
        return low + (high - low) * part

    return found.groupBy(*by).agg(*[blended(n).alias(n) for n in specs])


def percentile_disc(df: DataFrame, column: str, p: str | float, out: str, by=()) -> DataFrame:
    return percentiles(df, {out: (column, p)}, by)


def few_valued_percentile(
    df: DataFrame, column: str, p: str | float, out: str, by: Sequence[str] = (), count: str | None = None,
) -> DataFrame:
    """``percentile_disc`` for a column of few distinct values: one count of them.

    Each row stands for itself, or for as many rows as ``count`` says.  The counts of a group's values are summed in one task, so their number, not
    the rows', has to be small.
    """
    by = list(by)
    counts = df.where(F.col(column).isNotNull()).groupBy(*by, column).agg(
        (F.sum(count) if count else F.count("*")).alias("__n")
    )
    until = Window.partitionBy(*by).orderBy(column).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    reached = counts.withColumn("__last", F.sum("__n").over(until)).withColumn(
        "__rank", F.greatest(F.ceil(F.sum("__n").over(Window.partitionBy(*by)) * F.lit(Decimal(str(p)))), F.lit(1))
    )
    return reached.where(F.col("__last") >= F.col("__rank")).groupBy(*by).agg(F.min(column).alias(out))


def median(df: DataFrame, column: str, out: str, by=()) -> DataFrame:
    return percentiles(df, {out: (column, "0.5")}, by, interpolate=True)


# The part of ``monotonically_increasing_id`` below the partition's number.
_PLACE_BITS = 33


def with_position(df: DataFrame, order: Sequence[Column], out: str, total: str) -> DataFrame:
    """The place of every row in a total order, from 1, and the number of all rows.

    Rows are dealt to ranges of the order, sorted within each and written with
    their place there; a row's place among all is that plus the sizes of the
    ranges before, one count per range.  One shuffle, no window over rows.  The
    order should end in a unique column, so that ties are dealt to ranges too;
    nulls and texts sort as in ``orderBy``.
    """
    placed = staged(
        df.repartitionByRange(*order).sortWithinPartitions(*order)
        .withColumn("__row", F.monotonically_increasing_id()), "ordered",
    ).withColumn("__range", F.shiftright("__row", _PLACE_BITS))
    # One row per range: at most the number of shuffle partitions.
    sizes = placed.groupBy("__range").agg(F.count("*").alias("__n"))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select(
        "__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"),
        F.sum("__n").over(Window.partitionBy()).alias(total),
    )
    place = F.col("__row").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1)) + F.col("__base") + 1
    return placed.join(F.broadcast(bases), "__range").select(
        *df.columns, place.alias(out), F.col(total)
    )


def tiers(df: DataFrame, k: int, order: str, tie_break: str, out: str) -> DataFrame:
    """Split all rows into ``k`` equal tiers by ``order``, ties by ``tie_break``.

    Missing values come last.  ``tie_break`` should be unique; texts are ordered
    by their bytes.  With ``n = q*k + r`` rows the first ``r`` tiers hold
    ``q + 1`` rows; with fewer rows than tiers each row is a tier.
    """
    sort = [F.col(order).asc_nulls_last(), F.col(tie_break).asc_nulls_last()]
    placed = with_position(df, sort, "__place", "__total")
    size, extra = F.floor(F.col("__total") / k), F.col("__total") % k
    before, larger = F.col("__place") - 1, F.col("__total") % k * (F.floor(F.col("__total") / k) + 1)
    tier = F.when(before < larger, F.floor(before / (size + 1))).otherwise(
        extra + F.floor((before - larger) / F.greatest(size, F.lit(1)))
    )
    return placed.select(*df.columns, (tier + 1).cast("int").alias(out))


def rank_groups(df: DataFrame, by: str, out: str, descending: bool = True) -> DataFrame:
    """Dense rank of an aggregated result by one column.

    For results with a fixed small number of groups, such as calendar months: the
    window spans all rows of ``df``.
    """
    order = F.col(by).desc_nulls_last() if descending else F.col(by).asc_nulls_last()
    return df.withColumn(out, F.dense_rank().over(Window.orderBy(order)))


def top_k(df: DataFrame, by: str, k: int, ties: Sequence[str]) -> DataFrame:
    """The ``k`` rows with the largest value; ties are settled by other columns."""
    order = [F.col(by).desc_nulls_last(), *[F.col(t).asc_nulls_last() for t in ties]]
    return df.orderBy(*order).limit(k)
