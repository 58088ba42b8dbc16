"""Order statistics, tiers and top-k against brute force."""

import math
from decimal import Decimal

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from tallyframe.operators import ranking

SKEWED = (
    [5.0] * 40 + [None] * 10 + [-1e300, -7.25, -1e-300, 0.0, -0.0, 1e-300, 3e-9, 0.1, 1e15, 1e300]
    + [float(i) for i in range(50)]
)


def brute_disc(values, p):
    known = sorted(v for v in values if v is not None)
    return known[max(math.ceil(Decimal(p) * len(known)), 1) - 1]


@pytest.mark.parametrize("p", ["0", "0.01", "0.25", "0.5", "0.9", "0.99", "1"])
def test_discrete_percentile(spark, p):
    df = spark.createDataFrame([(v,) for v in SKEWED], "v double")
    got = ranking.percentile_disc(df, "v", p, "q").first()["q"]
    assert got == brute_disc(SKEWED, p)


def test_interpolated_percentiles_by_group(spark):
    rng = np.random.default_rng(7)
    groups = {"a": rng.lognormal(3, 2, 301), "b": rng.normal(0, 1, 40), "c": np.array([2.5]),
              None: np.array([1.0, 4.0])}
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs]
    df = spark.createDataFrame(rows, "g string, v double")
    got = ranking.percentiles(
        df, {"q1": ("v", "0.25"), "q2": ("v", "0.5"), "q3": ("v", "0.75")}, ["g"], interpolate=True
    ).collect()
    assert len(got) == len(groups)
    for row in got:
        expected = np.percentile(groups[row["g"]], [25, 50, 75])
        np.testing.assert_allclose([row["q1"], row["q2"], row["q3"]], expected, rtol=1e-12)


def test_percentiles_of_several_columns_and_empty_input(spark):
    df = spark.createDataFrame([(1, None), (2, None), (3, None)], "a int, b double")
    row = ranking.percentiles(df, {"a": ("a", "0.5"), "b": ("b", "0.5")}).first()
    assert row["a"] == 2 and row["b"] is None


def test_decimal_rank_is_exact(spark):
    # 0.99 * 100 rows is rank 99 exactly, not 100.
    df = spark.range(1, 101).select(F.col("id").cast("decimal(18,2)").alias("v"))
    assert ranking.percentile_disc(df, "v", 0.99, "q").first()["q"] == Decimal("99.00")


def brute_tiers(rows, k):
    ordered = sorted(rows, key=lambda r: (r[1], r[0]))
    size, extra = divmod(len(ordered), k)
    tiers, at = {}, 0
    for tier in range(1, k + 1):
        for _ in range(size + (tier <= extra)):
            tiers[ordered[at][0]] = tier
            at += 1
    return tiers


@pytest.mark.parametrize("k", [1, 2, 3, 7])
def test_seven_equal_values_split_by_tie_break(spark, k):
    rows = [(i, 1.5) for i in range(7)]
    df = spark.createDataFrame(rows, "id long, v double")
    got = {r["id"]: r["tier"] for r in ranking.tiers(df, k, "v", "id", "tier").collect()}
    assert got == brute_tiers(rows, k)


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(
    values=st.lists(st.sampled_from([0.0, 0.5, 0.5, 1.0, 2.25, 100.0, -3.0]), min_size=1, max_size=60),
    k=st.integers(2, 5),
)
def test_tiers_agree_with_a_global_sort(spark, values, k):
    rows = list(enumerate(values))
    df = spark.createDataFrame(rows, "id long, v double")
    got = {r["id"]: r["tier"] for r in ranking.tiers(df, k, "v", "id", "tier").collect()}
    assert got == brute_tiers(rows, k)
    sizes = [list(got.values()).count(t) for t in range(1, k + 1)]
    assert max(sizes) - min(sizes) <= 1


def test_a_third_of_all_rows_in_one_value(spark):
    df = spark.range(30_000).select(
        "id", F.when(F.col("id") < 10_000, 7.0).otherwise(F.sqrt("id")).alias("v")
    )
    values = np.sort([7.0 if i < 10_000 else math.sqrt(i) for i in range(30_000)])
    row = ranking.percentiles(df, {"a": ("v", "0.2"), "b": ("v", "0.7")}).first()
    assert row["a"] == values[math.ceil(0.2 * 30_000) - 1]
    assert row["b"] == values[21_000 - 1]


def test_cells_never_decrease(spark):
    values = sorted({float(v) for v in np.random.default_rng(3).normal(0, 1e6, 5000)}
                    | {0.0, 1e-308, -1e-308, 5e-324, 1.7e308, -1.7e308})
    df = spark.createDataFrame([(v,) for v in values], "v double").coalesce(1)
    cells = [r[0] for r in df.orderBy("v").select(ranking._cell(F.col("v"))).collect()]
    assert cells == sorted(cells)


def test_top_k_settles_ties_and_rank_groups_is_dense(spark):
    df = spark.createDataFrame([("b", 3), ("a", 3), ("c", 9), ("d", 1)], "name string, n int")
    assert [r["name"] for r in ranking.top_k(df, "n", 3, ["name"]).collect()] == ["c", "a", "b"]
    ranks = {r["name"]: r["rank"] for r in ranking.rank_groups(df, "n", "rank").collect()}
    assert ranks == {"c": 1, "a": 2, "b": 2, "d": 3}


def test_infinite_and_missing_numbers(spark):
    inf = math.inf
    values = [inf, -inf, 1e308, 1.0, float("nan"), None, inf, 2.0]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    known = sorted(v for v in values if v is not None and not math.isnan(v))
    for i in range(1, len(known) + 1):
        p = Decimal(i) / len(known)
        row = ranking.percentiles(df, {"q": ("v", str(round(p - Decimal("0.01"), 6)))}).first()
        assert row["q"] == known[i - 1]


def test_few_valued_percentile(spark):
    df = spark.createDataFrame([("a", 3), ("a", 1), ("a", 2), ("a", 2), ("b", None), (None, 7)], "g string, v int")
    got = {r["g"]: r["q"] for r in ranking.few_valued_percentile(df, "v", "0.5", "q", ["g"]).collect()}
    assert got == {"a": 2, None: 7}


def test_tiers_break_ties_by_text(spark):
    names = [f"player-{i % 7}-{'x' * (i % 5)}{i}" for i in range(200)]
    rows = [(n, i % 3) for i, n in enumerate(names)]
    got = {r["id"]: r["t"] for r in ranking.tiers(
        spark.createDataFrame(rows, "id string, v int"), 4, "v", "id", "t").collect()}
    order = sorted(rows, key=lambda r: (r[1], r[0].encode()))
    assert got == {n: 1 + i // 50 for i, (n, _) in enumerate(order)}


def test_cells_are_written_and_read_back(spark):
    df = spark.range(1000).select((F.col("id") % 7).alias("g"), (F.col("id") * 1.5).alias("v"))
    result = ranking.percentiles(df, {"q": ("v", "0.5")}, ["g"])
    assert "InMemoryTableScan" not in result._jdf.queryExecution().executedPlan().toString()
    assert any("/wanted-cells-" in file for file in result.inputFiles())


def _with_hot_value(spark, kind):
    # A third of all rows share one value, some have none.
    rows = [(f"{'k' * (i % 4)}{i}" if kind == "text" else i * 7 % 997, 5.0 if i % 3 == 0 else float(i % 50) or None)
            for i in range(997)]
    return rows, spark.createDataFrame(rows, f"id {'string' if kind == 'text' else 'long'}, v double")


@pytest.mark.parametrize("kind", ["text", "number"])
@pytest.mark.parametrize("k", [1, 3, 10, 2000])
def test_tiers_like_ntile(spark, kind, k):
    rows, df = _with_hot_value(spark, kind)
    got = {r["id"]: r["t"] for r in ranking.tiers(df, k, "v", "id", "t").collect()}
    order = sorted(rows, key=lambda r: (r[1] is None, r[1] or 0.0, r[0].encode() if kind == "text" else r[0]))
    size, extra = divmod(len(rows), k)
    expected = {}
    for place, (key, _) in enumerate(order):
        big = extra * (size + 1)
        expected[key] = 1 + (place // (size + 1) if place < big else extra + (place - big) // size)
    assert got == expected


def test_positions_need_no_window_over_rows(spark):
    _, df = _with_hot_value(spark, "number")
    placed = ranking.with_position(df, [F.col("v").asc_nulls_last(), F.col("id")], "place", "total")
    assert sorted(r["place"] for r in placed.collect()) == list(range(1, 998))
    assert {r["total"] for r in placed.collect()} == {997}
    plan = placed._jdf.queryExecution().optimizedPlan().toString()
    # The only windows stand above the count per range.
    assert plan.rindex("Window [") < plan.index("Aggregate [__range")


def test_positions_of_an_empty_table(spark):
    empty = spark.createDataFrame([], "id long, v double")
    assert ranking.tiers(empty, 3, "v", "id", "t").collect() == []
