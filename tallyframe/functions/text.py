"""Text normalisation, keyword flags and the two text-coded columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, functions as F

# The sales regions, one bit each, in the order of the zone codes.
ZONE_REGIONS = ("EU", "CIS", "APAC", "N.America")


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def normalised(text: Column | str) -> Column:
    """Lower case without surrounding white space of any kind."""
    return F.regexp_replace(F.lower(_col(text)), r"^\s+|\s+$", "")


def contains_all(text: Column | str, words: Sequence[str]) -> Column:
    """1 when every word occurs in the text, ignoring case, else 0."""
    lowered = F.lower(_col(text))
    found = F.lit(True)
    for word in words:
        found = found & lowered.contains(word.lower())
    return F.coalesce(found, F.lit(False)).cast("int")


def mapped(value: Column | str, mapping: Mapping[str, str]) -> Column:
    """Replace the listed values and keep all others."""
    value = _col(value)
    if not mapping:
        return value
    pairs = [F.lit(part) for pair in mapping.items() for part in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), value), value)


def labelled(value: Column | str, mapping: Mapping, default: str) -> Column:
    """Label by equality; anything else, missing values included, gets the default."""
    value = _col(value)
    result = F
    for key, label in mapping.items():
        result = result.when(value == F.lit(key), label)
    return result.otherwise(default) if mapping else F.lit(default)


def bucketed(value: Column | str, bounds: Sequence, labels: Sequence[str]) -> Column:
    """Label by ascending inclusive upper bounds.

    ``labels`` has one entry more than ``bounds``; the last one takes the values
    above every bound and the missing ones.
    """
    if len(labels) != len(bounds) + 1:
        raise ValueError("labels must have one entry more than bounds")
    value = _col(value)
    result = F
    for bound, label in zip(bounds, labels):
        result = result.when(value <= F.lit(bound), label)
    return result.otherwise(labels[-1])


def zone_mask(details: Column | str) -> Column:
    """The number inside ``ZONE_CODEnn``; null for any other content."""
    digits = F.regexp_extract(_col(details), r"^ZONE_CODE(\d{2})$", 1)
    return F.when(digits != "", digits.cast("int"))


def zone_regions(details: Column | str) -> Column:
    """The regions whose bit is set in a zone code, as an array."""
    mask = zone_mask(details)
    hits = [
        F.when(mask.bitwiseAND(1 << bit) != 0, F.lit(name))
        for bit, name in enumerate(ZONE_REGIONS)
    ]
    return F.when(mask.isNotNull(), F.array_compact(F.array(*hits)))


def numeric_details(details: Column | str) -> Column:
    """The amount held in a mixed text column; null where it is not a number."""
    return _col(details).try_cast("decimal(18,2)")


def bill_middle(text: Column | str, prefix: str) -> Column:
    """Middle of a textual price range that starts with ``prefix``.

    Two numbers give their midpoint, a single one is taken as is, everything
    else is null.
    """
    text = _col(text)
    numbers = F.regexp_extract_all(text, F.lit(r"(\d+)"), F.lit(1))
    first = F.try_element_at(numbers, F.lit(1)).try_cast("double")
    second = F.try_element_at(numbers, F.lit(2)).try_cast("double")
    return F.when(
        text.startswith(prefix),
        F.when(F.size(numbers) == 2, (first + second) / 2).when(F.size(numbers) == 1, first),
    )
