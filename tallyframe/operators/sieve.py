"""A bit field of keys that tells, before any shuffle, which rows cannot match.

Every key sets one bit of a field of fixed length.  A row whose bit is not set
surely has no partner; one whose bit is set may have one and still needs an exact
step.  The field is built by an aggregate that every task reduces first.  It is at
most ``FIELD_BITS`` / 8 bytes whatever the number of keys, so it can be broadcast;
with far more keys than bits it lets most rows through and the exact step does
the work, with the same result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

FIELD_BITS = 1 << 26  # 8 MB; a power of two
PART_SHIFT = 15  # one value of ``bitmap_construct_agg`` holds 2^15 bits


def _slot(keys: Sequence[Column]) -> Column:
    """Bit operations are never null, so the planner adds no filter that hashes once more."""
    return F.xxhash64(*keys).bitwiseAND(F.lit(FIELD_BITS - 1))


def _part(slot: Column) -> Column:
    return F.shiftright(slot, PART_SHIFT)


def _position(slot: Column) -> Column:
    return slot.bitwiseAND(F.lit((1 << PART_SHIFT) - 1))


def key_field(df: DataFrame, keys: Sequence[Column]) -> DataFrame:
    """(part, bits): the bit field of the keys of ``df``, cut into parts."""
    slots = df.select(_slot(keys).alias("slot")).select(
        _part(F.col("slot")).alias("part"), _position(F.col("slot")).alias("position")
    )
    return slots.groupBy("part").agg(F.bitmap_construct_agg("position").alias("bits"))


def _met(df: DataFrame, keys: Sequence[Column], field: DataFrame, how: str) -> DataFrame:
    name = "__slot"
    position = _position(F.col(name))
    byte = F.conv(F.hex(F.substring("bits", F.shiftright(position, 3) + 1, F.lit(1))), 16, 10)
    is_set = F.getbit(byte.cast("int"), position.bitwiseAND(F.lit(7))) == 1
    same_part = _part(F.col(name)) == F.col("part")
    return df.withColumn(name, _slot(keys)).join(F.broadcast(field), same_part & is_set, how).drop(name)


def may_match(df: DataFrame, keys: Sequence[Column], field: DataFrame) -> DataFrame:
    """Rows whose key may be in the field: all that are, and a few that are not."""
    return _met(df, keys, field, "left_semi")


def cannot_match(df: DataFrame, keys: Sequence[Column], field: DataFrame) -> DataFrame:
    """The other rows; their key is surely not in the field."""
    return _met(df, keys, field, "left_anti")
