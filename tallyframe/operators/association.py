"""Association of mixed columns with one target: chi-square, Cramer's V, phi_K.

Spark counts the contingency tables of all columns in one pass.  The phi_K
coefficient (arXiv:1811.11440) is then solved for one aggregated row per column:
it is the correlation of a binned bivariate normal distribution that gives the
same chi-square value.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

from tallyframe.functions.numeric import quotient
from tallyframe.sources.staging import staged

# The solver travels to the workers by value; they need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# The binned normal distribution spans five deviations each way.
NORMAL_REACH = 5.0
_NODES, _WEIGHTS = np.polynomial.legendre.leggauss(48)


def _binned(df: DataFrame, columns: Sequence[str], bins: int) -> dict[str, Column]:
    """Equal-width bin expressions; the ranges come from one scalar subquery."""
    if not columns:
        return {}
    row = df.agg(
        *[F.min(F.col(c).cast("double")).alias(f"lo_{c}") for c in columns],
        *[F.max(F.col(c).cast("double")).alias(f"hi_{c}") for c in columns],
    )
    ends = row.select(F.struct(*row.columns)).scalar()
    result = {}
    for c in columns:
        low, high = ends[f"lo_{c}"], ends[f"hi_{c}"]
        position = quotient(F.col(c).cast("double") - low, high - low) * bins
        index = F.least(F.floor(F.coalesce(position, F.lit(0.0))), F.lit(bins - 1))
        result[c] = F.when(F.col(c).isNotNull(), index.cast("string"))
    return result


def contingency(
    df: DataFrame, target: str, columns: Sequence[str], interval_columns: Sequence[str], bins: int
) -> DataFrame:
    """Joint counts of each column with the target; rows with a gap are left out."""
    binned = _binned(df, [c for c in [target, *columns] if c in interval_columns], bins)

    def level(c: str) -> Column:
        return binned.get(c, F.col(c).cast("string"))

    levels = df.select(
        level(target).alias("y"),
        F.inline(F.array(*[
            F.struct(F.lit(c).alias("column_name"), level(c).alias("x")) for c in columns
        ])),
    )
    return levels.where(F.col("x").isNotNull() & F.col("y").isNotNull()).groupBy(
        "column_name", "x", "y"
    ).agg(F.count("*").alias("n"))


def chi_square(table: DataFrame) -> DataFrame:
    """Chi-square and Cramer's V per column from its contingency table.

    Cells without rows add their expected counts, which together are the total
    less the expected counts of the filled cells.  Counts are divided as doubles
    before they are multiplied.
    """
    table = staged(table, "contingency")
    by_x = table.groupBy("column_name", "x").agg(F.sum("n").alias("x_n"))
    by_y = table.groupBy("column_name", "y").agg(F.sum("n").alias("y_n"))
    sizes = by_x.groupBy("column_name").agg(F.sum("x_n").alias("total"), F.count("*").alias("nx"))
    sizes = sizes.join(
        by_y.groupBy("column_name").agg(F.count("*").alias("ny")), "column_name"
    )
    cells = (
        table.join(by_x, ["column_name", "x"]).join(by_y, ["column_name", "y"])
        .join(sizes.select("column_name", "total"), "column_name")
        .withColumn("e", quotient("x_n", "total") * F.col("y_n"))
        .groupBy("column_name")
        .agg(
            F.sum(quotient(F.pow(F.col("n") - F.col("e"), F.lit(2)), "e")).alias("filled"),
            F.sum("e").alias("e"),
        )
    )
    return sizes.join(cells, "column_name").select(
        "column_name", "total", "nx", "ny",
        F.greatest(F.col("filled") + (F.col("total") - F.col("e")), F.lit(0.0)).alias("chi2"),
    ).withColumn("cramers_v", F.sqrt(quotient(
        "chi2", F.col("total").cast("double") * (F.least("nx", "ny") - 1)
    )))


def _normal_cdf(values: np.ndarray) -> np.ndarray:
    erf = np.frompyfunc(math.erf, 1, 1)
    return 0.5 * (1.0 + erf(values / math.sqrt(2.0)).astype("float64"))


def _normal_table(rho: float, nx: int, ny: int) -> np.ndarray:
    """Probabilities of an nx by ny grid under a bivariate normal distribution."""
    if nx > ny:
        return _normal_table(rho, ny, nx).T
    x_edges = np.linspace(-NORMAL_REACH, NORMAL_REACH, nx + 1)
    y_edges = np.linspace(-NORMAL_REACH, NORMAL_REACH, ny + 1)
    if rho >= 1.0:
        low = np.maximum(x_edges[:-1, None], y_edges[None, :-1])
        high = np.minimum(x_edges[1:, None], y_edges[None, 1:])
        return np.where(high > low, _normal_cdf(np.maximum(high, low)) - _normal_cdf(low), 0.0)
    # Panels narrow enough for the conditional distribution of y given x.
    panels = max(1, math.ceil((x_edges[1] - x_edges[0]) / max(4 * math.sqrt(1 - rho * rho), 0.05)))
    fine = np.linspace(-NORMAL_REACH, NORMAL_REACH, nx * panels + 1)
    half = (fine[1:] - fine[:-1]) / 2
    table = np.empty((nx, ny))
    # A panel at a time, so that memory is bounded by one row of the table.
    for row in range(nx):
        mass = np.zeros(ny)
        for panel in range(row * panels, (row + 1) * panels):
            x = (fine[panel] + fine[panel + 1]) / 2 + half[panel] * _NODES
            weight = half[panel] * _WEIGHTS * np.exp(-x * x / 2) / math.sqrt(2 * math.pi)
            below = _normal_cdf((y_edges - rho * x[:, None]) / math.sqrt(1 - rho * rho))
            mass += weight @ np.diff(below, axis=1)
        table[row] = mass
    return table


def phi_k(chi2: float, n: float, nx: int, ny: int) -> float:
    """The correlation whose binned normal distribution has this chi-square.

    The degrees of freedom serve as the noise pedestal, the largest possible
    chi-square as the value at full correlation.
    """
    if nx < 2 or ny < 2:
        return float("nan")
    pedestal = float((nx - 1) * (ny - 1))
    largest = n * min(nx - 1, ny - 1)
    if chi2 <= pedestal:
        return 0.0
    if chi2 >= largest:
        return 1.0
    independent = _normal_table(0.0, nx, ny)

    def distance(rho: float) -> float:
        return float(((_normal_table(rho, nx, ny) - independent) ** 2 / independent).sum())

    wanted = (chi2 - pedestal) / (largest - pedestal) * distance(1.0)
    low, high = 0.0, 1.0
    for _ in range(40):
        middle = (low + high) / 2
        if distance(middle) < wanted:
            low = middle
        else:
            high = middle
    return (low + high) / 2


def _phi_k_of(stats: DataFrame) -> DataFrame:
    @F.pandas_udf("double")
    def solved(chi2: pd.Series, n: pd.Series, nx: pd.Series, ny: pd.Series) -> pd.Series:
        return pd.Series(
            [phi_k(c, t, int(a), int(b)) for c, t, a, b in zip(chi2, n, nx, ny)],
            dtype="float64",
        )

    return stats.withColumn("phi_k", solved("chi2", "total", "nx", "ny"))


def association(
    df: DataFrame, target: str, columns: Sequence[str], interval_columns: Sequence[str], bins: int = 10
) -> DataFrame:
    """Chi-square, Cramer's V and phi_K of each column with the target."""
    stats = chi_square(contingency(df, target, columns, interval_columns, bins))
    return _phi_k_of(stats)
