"""Joins by key: lookups, filters by another table, cohorts and overlaps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tallyframe.operators.sieve import cannot_match, key_field, may_match
from tallyframe.sources.staging import staged

WORD = 64  # days in one value of a user's calendar


def _keys(key: str | Sequence[str]) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def lookup(df: DataFrame, dimension: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """Attach dimension columns and keep rows without a match."""
    return df.join(dimension, _keys(key), "left")


def left_join_filtered(
    left: DataFrame, right: DataFrame, key: str | Sequence[str], predicate: Column
) -> DataFrame:
    """Left join whose right side is restricted first, so no left row is lost."""
    return left.join(right.where(predicate), _keys(key), "left")


def null_safe_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner"
) -> DataFrame:
    """Equi-join in which missing keys match each other."""
    renamed = right.withColumnsRenamed({k: f"{k}__r" for k in keys})
    condition = [F.col(k).eqNullSafe(F.col(f"{k}__r")) for k in keys]
    return left.join(renamed, condition, how).drop(*[f"{k}__r" for k in keys])


def _field_of(df: DataFrame, others: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The bit field of the other table's keys, in the types of ``df``, so that equal keys set equal bits.

    A text that is compared with a number has many spellings; such keys are refused.
    """
    types, other_types = dict(df.dtypes), dict(others.dtypes)
    if any(types[k] == "string" != other_types[k] for k in keys):
        raise TypeError("cast both keys to one type: texts cannot be sieved by other values")
    return key_field(others, [F.col(k).try_cast(types[k]) for k in keys])


def keep_ids(
    df: DataFrame, ids: DataFrame, key: str | Sequence[str], sieve: bool = False
) -> DataFrame:
    """Rows whose key occurs in another table.

    With ``sieve``, rows that surely have no partner are dropped before the join
    shuffles them: for many ids that match few rows.
    """
    keys = _keys(key)
    ids = ids.select(*keys).distinct()
    if sieve:
        df = may_match(df, [F.col(k) for k in keys], _field_of(df, ids, keys))
    return df.join(ids, keys, "left_semi")


def exclude_ids(
    df: DataFrame, ids: DataFrame, key: str | Sequence[str], sieve: bool = False
) -> DataFrame:
    """Rows whose key does not occur in another table; missing keys stay.

    With ``sieve``, rows that surely have no partner stay where they are and only
    the others are shuffled by the join; ``df`` is then scanned twice.
    """
    keys = _keys(key)
    ids = ids.select(*keys).distinct()
    if not sieve:
        return df.join(ids, keys, "left_anti")
    columns, field = [F.col(k) for k in keys], _field_of(df, ids, keys)
    return cannot_match(df, columns, field).unionByName(
        may_match(df, columns, field).join(ids, keys, "left_anti")
    )


def cohort_activity(df: DataFrame, user: str, day: str, base_day, out: str) -> DataFrame:
    """Distinct (user, day offset) pairs from the base day on, for users active on it.

    Groupings by user replace the join of the base day's users with all later
    activity.  Each task first merges a user's days into words of 64 bits, one bit
    a day, so a user's state is the calendar's length in bits; then users whose
    first word lacks the base day are dropped.
    """
    base = F.lit(base_day).cast("date")
    days = df.where((F.col(day) >= base) & F.col(user).isNotNull()).select(
        user, F.datediff(F.col(day), base).alias("__offset")
    )
    words = days.groupBy(user, F.expr(f"__offset div {WORD}").alias("__word")).agg(
        F.expr(f"bit_or(shiftleft(1L, __offset % {WORD}))").alias("__bits")
    )
    users = words.groupBy(user).agg(
        F.collect_list(F.struct("__word", "__bits")).alias("__words"),
        F.bool_or((F.col("__word") == 0) & (F.getbit("__bits", F.lit(0)) == 1)).alias("__installed"),
    ).where("__installed")
    bits = F.filter(
        F.sequence(F.lit(0), F.lit(WORD - 1)), lambda i: F.getbit(F.col("__w.__bits"), i) == 1
    )
    return (
        users.select(user, F.explode("__words").alias("__w"))
        .select(user, F.col("__w.__word").alias("__word"), F.explode(bits).alias("__bit"))
        .select(user, (F.col("__word") * WORD + F.col("__bit")).cast("int").alias(out))
    )


def overlap(df: DataFrame, key: str, in_a: Column, in_b: Column) -> DataFrame:
    """How many ids are only in A, only in B and in both; one row.

    Each id is reduced to two flags, so set sizes never leave the executors.
    """
    flags = df.groupBy(key).agg(
        F.bool_or(F.coalesce(in_a, F.lit(False))).alias("a"),
        F.bool_or(F.coalesce(in_b, F.lit(False))).alias("b"),
    ).where(F.col(key).isNotNull())
    return flags.agg(
        F.count_if(F.col("a") & ~F.col("b")).alias("only_a"),
        F.count_if(~F.col("a") & F.col("b")).alias("only_b"),
        F.count_if(F.col("a") & F.col("b")).alias("both"),
    )


def first_events(df: DataFrame, user: str, is_event: Column, clock: str, out: str) -> DataFrame:
    """Time of each user's first marked event; a user without one is absent."""
    return df.where(is_event & F.col(clock).isNotNull()).groupBy(user).agg(F.min(clock).alias(out))


def with_first_event(
    df: DataFrame, user: str, is_event: Column, clock: str, out: str
) -> DataFrame:
    """Attach the time of each user's first marked event; users without it drop out.

    The minimum is pre-aggregated per task and written, one row per user, so the
    join back knows its size.  It is a plain equi-join, in which adaptive execution
    splits the rows of a very active user; a window over the user would sort them
    in one task.
    """
    first = staged(first_events(df, user, is_event, clock, out), "first-events")
    return df.join(first, user)
