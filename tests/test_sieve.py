"""The bit field of keys, and what is built on it: equal rows, joins, calendars."""

import math
from collections import Counter
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from tallyframe.operators import joins, profile, sieve


def exchanges(df):
    """Rows written by each exchange of the executed plan."""
    def walk(node):
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            yield from walk(node.executedPlan())
        elif name.endswith("QueryStageExec"):
            yield from walk(node.plan())
        else:
            if name == "ShuffleExchangeExec":
                yield node.metrics().apply("shuffleRecordsWritten").value()
            for below in (node.children(), node.subqueries()):
                for i in range(below.size()):
                    yield from walk(below.apply(i))
    df.collect()
    return list(walk(df._jdf.queryExecution().executedPlan()))


ROWS = [
    (1, "a", 1.0), (1, "a", 1.0), (1, None, 1.0), (None, "a", 1.0), (None, "a", 1.0), (None, None, None),
    (None, None, None), (2, "", 0.0), (2, "", -0.0), (3, "x", math.nan), (3, "x", math.nan), (4, "é\n", 2.0),
]


@pytest.mark.parametrize("digest", [None, ("7L",), ("n", "0L")])
def test_equal_rows_whatever_the_digest(spark, digest):
    df = spark.createDataFrame(ROWS, "n int, s string, v double")
    row = profile.duplicate_count(df, digest=digest and [F.expr(d) for d in digest]).first()
    assert (row["row_count"], row["duplicates"]) == (12, 5)


def test_digests_are_made_once_and_rows_compared_once(spark, tmp_path):
    spark.range(5000).selectExpr("id % 4990 AS a", "string(id % 4990) AS b").write.parquet(str(tmp_path / "t"))
    counted = profile.duplicate_count(spark.read.parquet(str(tmp_path / "t")))
    rows = exchanges(counted)
    assert counted.first()["duplicates"] == 10
    # Only the digests move as a whole; of the rows those that occur again.
    assert [n for n in rows if n > 100] == [5000] and any(10 <= n <= 30 for n in rows)
    plan = counted._jdf.queryExecution().executedPlan().toString()
    assert "ReusedExchange" in plan


def test_no_rows(spark):
    empty = spark.createDataFrame([], "n int, s string")
    assert profile.duplicate_count(empty).first().asDict() == {"row_count": 0, "duplicates": 0}


def test_a_third_of_all_rows_equal(spark):
    df = spark.range(9000).select(
        F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id")).alias("a"), F.lit("w").alias("b")
    )
    assert profile.duplicate_count(df).first()["duplicates"] == 2999


def test_field_holds_every_key_and_few_others(spark):
    field = sieve.key_field(spark.range(0, 4000, 2), [F.col("id")])
    numbers = spark.range(4000)
    may = {r["id"] for r in sieve.may_match(numbers, [F.col("id")], field).collect()}
    cannot = {r["id"] for r in sieve.cannot_match(numbers, [F.col("id")], field).collect()}
    assert may | cannot == set(range(4000)) and not may & cannot
    assert set(range(0, 4000, 2)) <= may and len(may) < 2010


def test_crowded_field_gives_the_same_rows(spark, monkeypatch):
    monkeypatch.setattr(sieve, "FIELD_BITS", 8)
    df = spark.range(300).select(F.when(F.col("id") != 5, F.col("id")).alias("id"))
    ids = spark.range(0, 300, 3)
    for f in (joins.keep_ids, joins.exclude_ids):
        plain, sieved = (Counter(r["id"] for r in f(df, ids, "id", sieve=s).collect()) for s in (False, True))
        assert plain == sieved


@pytest.mark.parametrize("kind", ["int", "long", "string", "double"])
def test_sieved_joins_keep_the_same_rows(spark, kind):
    df = spark.range(500).select(F.when(F.col("id") % 50 > 0, F.col("id") % 90).cast("int").alias("k"), "id")
    ids = spark.range(0, 200, 7).select(F.col("id").cast(kind).alias("k")).union(spark.sql("SELECT NULL"))
    for f in (joins.keep_ids, joins.exclude_ids):
        plain, sieved = (Counter(r["id"] for r in f(df, ids, "k", sieve=s).collect()) for s in (False, True))
        assert plain == sieved
    none = ids.where("k IS NULL").limit(0)
    assert joins.keep_ids(df, none, "k", sieve=True).count() == 0
    assert joins.exclude_ids(df, none, "k", sieve=True).count() == 500


def test_texts_are_not_sieved_by_numbers(spark):
    with pytest.raises(TypeError):
        joins.keep_ids(spark.sql("SELECT '07' AS id"), spark.range(9), "id", sieve=True)


def test_sieve_spares_the_shuffle(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df, ids = spark.range(20000), spark.range(0, 20000, 100)
        for f in (joins.keep_ids, joins.exclude_ids):
            assert max(exchanges(f(df, ids, "id"))) == 20000
            assert max(exchanges(f(df, ids, "id", sieve=True))) < 400
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_calendars_over_many_words(spark):
    base = date(2024, 1, 21)
    offsets = {1: [0, 63, 64, 65, 127, 128, 5000], 2: [1, 64], 3: [0], 4: [0, 0, 31, 32], 5: [-1, 0]}
    rows = [(u, base + timedelta(days=o)) for u, days in offsets.items() for o in days]
    rows += [(1, date(9999, 12, 31)), (None, base), (6, None)]
    df = spark.createDataFrame(rows, "u int, d date")
    found = Counter(tuple(r) for r in joins.cohort_activity(df, "u", "d", "2024-01-21", "day").collect())
    wanted = {(u, (d - base).days) for u, d in rows if u in (1, 3, 4, 5) and d and d >= base}
    assert found == Counter(wanted)
