"""Cleaning: gaps, normalised text, duplicates, replaced values, flags."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from tallyframe.functions.text import contains_all, mapped, normalised


def drop_missing(df: DataFrame, subset: Sequence[str]) -> DataFrame:
    """Rows with a value in every listed column; not-a-number counts as missing."""
    kinds = dict(df.dtypes)
    for c in subset:
        df = df.where(F.col(c).isNotNull())
        if kinds[c] in ("double", "float"):
            df = df.where(~F.isnan(c))
    return df


def cast_columns(df: DataFrame, types: Mapping[str, str], strict: bool = True) -> DataFrame:
    """Cast columns to explicit types; bad input raises, or turns null if not strict."""
    return df.withColumns({
        c: F.col(c).cast(t) if strict else F.col(c).try_cast(t) for c, t in types.items()
    })


def normalise_text(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Lower case without surrounding white space."""
    return df.withColumns({c: normalised(c) for c in columns})


def map_values(df: DataFrame, column: str, mapping: Mapping[str, str]) -> DataFrame:
    """Replace whole values by a dictionary, others stay."""
    return df.withColumn(column, mapped(column, mapping))


def replace_text(df: DataFrame, column: str, old: str, new: str) -> DataFrame:
    """Replace a substring wherever it occurs."""
    return df.withColumn(column, F.replace(F.col(column), F.lit(old), F.lit(new)))


def presence_flag(df: DataFrame, column: str, out: str) -> DataFrame:
    """1 where the column has a value, 0 where it is missing."""
    return df.withColumn(out, F.col(column).isNotNull().cast("int"))


def keyword_flag(df: DataFrame, column: str, words: Sequence[str], out: str) -> DataFrame:
    """1 where the text contains every word, ignoring case."""
    return df.withColumn(out, contains_all(column, words))


def dedupe_first(df: DataFrame, keys: Sequence[str], row_id: str) -> DataFrame:
    """Keep the row with the smallest id of each key; missing keys are equal.

    ``row_id`` must be unique.  Only keys and ids are grouped, and every task
    reduces its share first, so a key shared by a large part of the table costs
    one row per task.  The kept rows are then picked by id with just the columns
    that the caller uses.
    """
    kept = df.groupBy(*keys).agg(F.min(row_id).alias(row_id)).select(row_id)
    return df.join(kept, row_id, "left_semi")


def drop_ambiguous(df: DataFrame, key: str) -> DataFrame:
    """Drop every row whose key occurs more than once; a single row without key stays."""
    single = df.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") == 1)
    known = df.join(single, key, "left_semi")
    missing = df.where(F.col(key).isNull())
    alone = missing.agg(F.count("*")).scalar() == 1
    return known.unionByName(missing.where(alone)).select(*df.columns)
