"""Order-insensitive comparison of a Spark result with a DuckDB result."""

from __future__ import annotations

import math
from decimal import Decimal

import duckdb
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(directory: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{directory}/{t}.parquet'")
    return con


def _plain(value):
    if value is None or value is pd.NaT or (isinstance(value, float) and math.isnan(value)):
        return None
    if hasattr(value, "item"):
        value = value.item()
    if isinstance(value, Decimal):
        raise AssertionError("results must not hold decimals")
    if isinstance(value, float) and value == int(value) and abs(value) < 1e15:
        return value + 0.0
    return value


def kinds(frame_types: dict[str, str]) -> dict[str, str]:
    names = {
        "bigint": "int", "int": "int", "integer": "int", "smallint": "int", "tinyint": "int",
        "hugeint": "huge", "double": "float", "float": "float", "string": "text",
        "varchar": "text", "timestamp_ntz": "time", "timestamp": "time",
    }
    return {c: names.get(t.lower(), t.lower()) for c, t in frame_types.items()}


def rows(columns, data):
    order = sorted(columns)
    return sorted(
        (tuple(_plain(dict(zip(columns, row))[c]) for c in order) for row in data), key=repr
    )


def assert_same(spark_df, con, sql: str) -> int:
    relation = con.execute(sql)
    theirs_types = {c[0]: str(c[1]) for c in relation.description}
    ours_types = dict(spark_df.dtypes)
    assert sorted(ours_types) == sorted(theirs_types), (sorted(ours_types), sorted(theirs_types))
    assert kinds(ours_types) == kinds(theirs_types), (kinds(ours_types), kinds(theirs_types))
    theirs = rows(list(theirs_types), relation.fetchall())
    ours = rows(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    assert len(ours) == len(theirs), (len(ours), len(theirs))
    for a, b in zip(ours, theirs):
        assert a == b, (sorted(ours_types), a, b)
    return len(ours)
