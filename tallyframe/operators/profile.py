"""Looking at a table: previews, profiles, keys, frequencies, distributions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tallyframe.functions.numeric import known, mean, quotient
from tallyframe.operators.joins import null_safe_join
from tallyframe.operators.ranking import percentiles
from tallyframe.operators.sieve import key_field, may_match


def with_total_count(df: DataFrame, out: str = "row_count") -> DataFrame:
    """The table's row count on each row, as a scalar subquery."""
    return df.withColumn(out, df.agg(F.count("*")).scalar())


def preview(df: DataFrame, n: int, key: str | Sequence[str]) -> DataFrame:
    """The first ``n`` rows by key, each with the table's row count."""
    keys = [key] if isinstance(key, str) else list(key)
    return with_total_count(df).orderBy(*keys).limit(n)


def _is_missing(df: DataFrame, column: str) -> Column:
    missing = F.col(column).isNull()
    if dict(df.dtypes)[column] in ("double", "float"):
        missing = missing | F.isnan(column)
    return missing


def _per_column(df: DataFrame, columns: Sequence[str], **measures) -> DataFrame:
    """One aggregate over the whole table, turned into one row per column."""
    types = dict(df.dtypes)
    row = df.agg(*[
        F.struct(
            F.lit(c).alias("column_name"),
            F.lit(types[c]).alias("data_type"),
            *[build(c).alias(name) for name, build in measures.items()],
        ).alias(f"c{i}")
        for i, c in enumerate(columns)
    ])
    return row.select(F.inline(F.array(*[F.col(f"c{i}") for i in range(len(columns))])))


def profile_columns(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Type, row count and non-null count of every column in one pass."""
    return _per_column(
        df, columns or df.columns,
        row_count=lambda c: F.count("*"),
        non_null_count=lambda c: F.count_if(~_is_missing(df, c)),
    )


def missing_report(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Missing count and percent of every column in one pass."""
    return _per_column(
        df, columns or df.columns,
        missing_count=lambda c: F.count_if(_is_missing(df, c)),
        missing_percent=lambda c: quotient(
            F.count_if(_is_missing(df, c)) * 100, F.count("*")
        ),
    ).drop("data_type")


def rows_with_nulls(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows with at least one missing value among the columns."""
    condition = F.lit(False)
    for c in columns:
        condition = condition | F.col(c).isNull()
    return df.where(condition)


def null_breakdown(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Among the incomplete rows, the non-null count of every column."""
    return rows_with_nulls(df, columns).agg(
        F.count("*").alias("row_count"), *[F.count(c).alias(c) for c in columns]
    )


def key_check(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows, distinct keys, rows with an incomplete key and uniqueness; one row."""
    any_null = F.lit(False)
    for c in columns:
        any_null = any_null | F.col(c).isNull()
    per_key = df.groupBy(*columns).agg(F.count("*").alias("n"))
    return per_key.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("row_count"),
        F.count_if(~any_null).alias("distinct_keys"),
        F.coalesce(F.sum(F.when(any_null, F.col("n"))), F.lit(0)).alias("null_keys"),
        F.coalesce(F.max("n") == 1, F.lit(True)).alias("unique_rows"),
    ).select(
        "row_count", "distinct_keys", "null_keys",
        (F.col("unique_rows") & (F.col("null_keys") == 0)).alias("is_key"),
    )


def fk_check(child: DataFrame, column: str, parent: DataFrame, parent_column: str) -> DataFrame:
    """Rows of the child that reference something, and those without a parent.

    The child is counted per key before the join, so a key that fills a large
    part of the table reaches the join as one row per task.
    """
    counted = child.where(F.col(column).isNotNull()).groupBy(
        F.col(column).alias("ref")
    ).agg(F.count("*").alias("n"))
    parents = parent.select(F.col(parent_column).alias("ref")).distinct().withColumn(
        "known", F.lit(True)
    )
    return counted.join(parents, "ref", "left").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("referencing_rows"),
        F.coalesce(F.sum(F.when(F.col("known").isNull(), F.col("n"))), F.lit(0)).alias(
            "orphan_rows"
        ),
    )


def match_count(df: DataFrame, left: str, right: str) -> DataFrame:
    """Rows, and rows in which two columns hold the same value."""
    return df.agg(
        F.count("*").alias("row_count"),
        F.count_if(F.col(left).eqNullSafe(F.col(right))).alias("matches"),
    )


def index_column_check(df: DataFrame, column: str) -> DataFrame:
    """Whether a column is nothing but a row number 0..n-1; one row."""
    return (
        df.groupBy(F.col(column).alias("v")).agg(F.count("*").alias("n"))
        .agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("row_count"),
            F.count("v").alias("distinct_values"),
            F.min("v").cast("bigint").alias("min_value"),
            F.max("v").cast("bigint").alias("max_value"),
        )
        .withColumn("is_row_number", F.coalesce(
            (F.col("distinct_values") == F.col("row_count"))
            & (F.col("min_value") == 0)
            & (F.col("max_value") == F.col("row_count") - 1),
            F.lit(False),
        ))
    )


def drop_index_column(df: DataFrame, column: str) -> DataFrame:
    return df.drop(column)


def row_digest(columns: Sequence[str]) -> list[Column]:
    """128 bits of a row; gaps count too, since the hash passes over them."""
    gaps = [F.col(c).isNull() for c in columns]
    return [F.xxhash64(F.lit(seed), *columns, *gaps) for seed in (1, 2)]


def duplicate_count(
    df: DataFrame, subset: Sequence[str] | None = None, digest: Sequence[Column] | None = None
) -> DataFrame:
    """Rows, and rows beyond the first of each equal group; missing values are equal.

    Whole rows are told apart by their digests first, so only digests are shuffled
    for rows that occur once.  Rows whose digest occurs again are compared as
    they are, so a clash of digests changes no count.
    """
    if subset:
        counts = df.groupBy(*subset).agg(F.count("*").alias("__n"))
        return counts.agg(_total("__n").alias("row_count"), _total(F.col("__n") - 1).alias("duplicates"))
    digest = list(digest or row_digest(df.columns))
    names = [f"__d{i}" for i in range(len(digest))]
    counts = df.select(*[d.alias(n) for d, n in zip(digest, names)]).groupBy(*names).agg(
        F.count("*").alias("__n")
    )
    repeated = key_field(counts.where("__n > 1"), [F.col(n) for n in names])
    equal = may_match(df, digest, repeated).groupBy(*df.columns).agg(F.count("*").alias("__n"))
    return counts.agg(_total("__n").alias("row_count")).withColumn(
        "duplicates", equal.agg(_total(F.col("__n") - 1)).scalar()
    )


def _total(column: Column | str) -> Column:
    return F.coalesce(F.sum(column), F.lit(0))


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    """The different values of a column, the missing one included, sorted."""
    return df.select(column).distinct().orderBy(F.col(column).asc_nulls_last())


def value_counts(df: DataFrame, column: str, out: str = "count") -> DataFrame:
    """Rows per non-missing value, most frequent first."""
    return (
        df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias(out))
        .orderBy(F.col(out).desc(), F.col(column).asc())
    )


def value_shares(df: DataFrame, column: str, out: str = "share") -> DataFrame:
    """Fraction of the non-missing rows per value, most frequent first."""
    counts = value_counts(df, column, "__n")
    everything = df.agg(F.count(column)).scalar()
    return counts.withColumn(out, quotient("__n", everything)).drop("__n")


def share_matrix(df: DataFrame, row: str, column: str, values: Sequence, prefix: str) -> DataFrame:
    """Fraction of each value inside a row group, one column per value, gaps 0."""
    known = df.where(F.col(row).isNotNull() & F.col(column).isNotNull())
    return known.groupBy(row).agg(*[
        quotient(F.count_if(F.col(column) == F.lit(v)), F.count("*")).alias(f"{prefix}{v}")
        for v in values
    ])


def pivot_count(
    df: DataFrame, index: str, column: str, counted: str, values: Sequence, prefix: str
) -> DataFrame:
    """Non-missing ``counted`` per index and column value; empty cells stay null."""
    known = df.where(F.col(index).isNotNull() & F.col(column).isNotNull())
    return known.groupBy(index).agg(*[
        F.nullif(F.count(F.when(F.col(column) == F.lit(v), F.col(counted))), F.lit(0)).alias(
            f"{prefix}{v}"
        )
        for v in values
    ])


def describe(
    df: DataFrame, column: str, by: Sequence[str] = ()
) -> DataFrame:
    """Count, mean, deviation, variance, extremes and interpolated quartiles.

    Not-a-number counts as missing in all of them.
    """
    by = list(by)
    x = known(column)
    moments = df.groupBy(*by).agg(
        F.count(x).alias("count"),
        mean(column).alias("mean"),
        F.stddev_samp(x.cast("double")).alias("std"),
        F.var_samp(x.cast("double")).alias("var"),
        F.min(x).cast("double").alias("min"),
        F.max(x).cast("double").alias("max"),
    )
    names = {"q25": "0.25", "q50": "0.5", "q75": "0.75"}
    quartiles = percentiles(
        df, {out: (column, p) for out, p in names.items()}, by, interpolate=True
    )
    if by:
        result = null_safe_join(moments, quartiles, by, "left")
    else:
        row = quartiles.select(F.struct(*names)).scalar()
        result = moments.withColumns({out: row[out] for out in names})
    return result.select(*by, "count", "mean", "std", "var", "min", *names, "max")
