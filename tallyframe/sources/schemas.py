"""Declared schemas and keys of the studied tables."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql.types import StructType

# Files the notebook studies read.  The mixed ``details`` column stays text.
CSV_SCHEMAS = {
    "online_library_data": "row_number bigint, city string, puid bigint, hours double",
    "ab_test_participants": "user_id string, `group` string, ab_test string, device string",
    "ab_test_events": "user_id string, event_dt timestamp_ntz, event_name string, details string",
    "ctr_info": (
        "id string, name string, address string, district string, category string, "
        "hours string, rating double, chain int, seats int"
    ),
    "ctr_price": (
        "id string, price string, avg_bill string, middle_avg_bill double, "
        "middle_coffee_cup double"
    ),
}


def csv_schema(name: str) -> StructType:
    return StructType.fromDDL(CSV_SCHEMAS[name])


@dataclass(frozen=True)
class TableKeys:
    """Primary key and foreign keys (column -> parent table, parent column)."""

    primary: tuple[str, ...]
    foreign: dict[str, tuple[str, str]] = field(default_factory=dict)


GAME_KEYS = {
    "users": TableKeys(
        ("id",),
        {
            "class_id": ("classes", "class_id"),
            "ch_id": ("skills", "ch_id"),
            "race_id": ("race", "race_id"),
            "loc_id": ("country", "loc_id"),
        },
    ),
    "events": TableKeys(
        ("transaction_id",), {"id": ("users", "id"), "item_code": ("items", "item_code")}
    ),
    "race": TableKeys(("race_id",)),
    "country": TableKeys(("loc_id",)),
    "classes": TableKeys(("class_id",)),
    "skills": TableKeys(("ch_id",)),
    "items": TableKeys(("item_code",)),
}

STAR_KEYS = {
    "region": TableKeys(("r_regionkey",)),
    "nation": TableKeys(("n_nationkey",), {"n_regionkey": ("region", "r_regionkey")}),
    "customer": TableKeys(("c_custkey",), {"c_nationkey": ("nation", "n_nationkey")}),
    "supplier": TableKeys(("s_suppkey",), {"s_nationkey": ("nation", "n_nationkey")}),
    "part": TableKeys(("p_partkey",)),
    "orders": TableKeys(("o_orderkey",), {"o_custkey": ("customer", "c_custkey")}),
    "lineitem": TableKeys(
        ("l_orderkey", "l_linenumber"),
        {
            "l_orderkey": ("orders", "o_orderkey"),
            "l_partkey": ("part", "p_partkey"),
            "l_suppkey": ("supplier", "s_suppkey"),
        },
    ),
}
