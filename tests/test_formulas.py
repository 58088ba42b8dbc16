"""Published figures and the distributions behind the tests."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyframe.functions import special
from tallyframe.functions.numeric import half_even, half_up, percent, quotient
from tallyframe.operators import experiment, stats
from tallyframe.operators.metrics import ratio_to_max


def test_retention_ratios(spark):
    counts = [4259, 2698, 2550, 2421, 2231, 1994, 2129, 2287, 2274, 2207]
    rates = [1, 0.63, 0.6, 0.57, 0.52, 0.47, 0.5, 0.54, 0.53, 0.52]
    df = spark.createDataFrame(list(enumerate(counts)), "day int, n long")
    got = ratio_to_max(df, "n", "rate").orderBy("day").collect()
    assert [r["rate"] for r in got] == rates


def test_revenue_per_hour(spark):
    df = spark.createDataFrame([(16320, 105539), (18280, 137384), (18594, 145351)], "mau long, h long")
    got = df.select(half_up(quotient(F.col("mau") * 399, "h")).alias("r")).collect()
    assert [r["r"] for r in got] == [61.7, 53.09, 51.04]


def test_group_sizes(spark):
    sizes = spark.createDataFrame([("m", 5990), ("s", 2306)], "city string, users long")
    row = experiment.compare_groups(sizes, "city", "users", "m", "s").first()
    assert round(100 * (row["control_users"] - row["test_users"]) / row["control_users"], 1) == 61.5


def test_conversion_and_z_test(spark):
    users = (
        spark.range(4952).select(F.lit("A").alias("group"), "id", (F.col("id") < 1377).alias("b"))
        .unionByName(
            spark.range(5011).select(
                F.lit("B").alias("group"), (F.col("id") + 10_000).alias("id"),
                (F.col("id") < 1480).alias("b"))
        )
    )
    rates = experiment.conversion(users, "group", "id", F.col("b"))
    got = {r["group"]: (r["total_users"], r["buying_users"], r["cr"]) for r in rates.collect()}
    assert got["A"] == (4952, 1377, 27.81)
    assert got["B"] == (5011, 1480, 29.54)
    assert experiment.conversion_diff(rates, "group", "A", "B").first()[0] == 1.73
    assert experiment.ztest_precondition(rates, "group").first()[0]
    test = stats.proportions_ztest(
        rates, "group", "total_users", "buying_users", "A", "B", "smaller").first()
    assert test["z_stat"] == pytest.approx(-1.906965, abs=1e-6)
    assert test["p_value"] == pytest.approx(0.028263, abs=1e-6)


def test_welch_from_published_moments(spark):
    row = spark.createDataFrame(
        [(5990, 10.85, 1363.50, 2306, 11.26, 1586.57)],
        "n_a long, mean_a double, var_a double, n_b long, mean_b double, var_b double",
    )
    test = stats.welch_from_moments(row, "smaller").first()
    assert test["t_stat"] == pytest.approx(-0.42847, abs=1e-5)
    assert test["dof"] == pytest.approx(3917.48, abs=0.01)
    assert test["p_value"] == pytest.approx(0.33417, abs=1e-5)


def test_required_sample():
    assert int(experiment.required_sample_size(0.3, 0.03, 0.05, 0.8)) == 3761


@pytest.mark.parametrize("t", [-40.0, -3.1, -0.4, 0.0, 0.7, 2.2, 9.0])
@pytest.mark.parametrize("df", [1.0, 2.5, 30.0, 3917.48])
def test_student_against_the_jvm(spark, t, df):
    jvm = spark._jvm.org.apache.commons.math3.distribution
    assert special.student_cdf(t, df) == pytest.approx(
        jvm.TDistribution(df).cumulativeProbability(t), abs=1e-9)


@pytest.mark.parametrize("f", [0.001, 0.25, 1.0, 3.9, 25.0])
@pytest.mark.parametrize("dofs", [(1.0, 1380.0), (3.0, 8.0), (10.0, 2.0)])
def test_f_against_the_jvm(spark, f, dofs):
    jvm = spark._jvm.org.apache.commons.math3.distribution
    assert special.f_sf(f, *dofs) == pytest.approx(
        1 - jvm.FDistribution(*dofs).cumulativeProbability(f), abs=1e-9)


@pytest.mark.parametrize("z", [-8.0, -1.96, 0.0, 0.5, 3.3])
def test_normal_against_the_jvm(spark, z):
    jvm = spark._jvm.org.apache.commons.math3.distribution
    assert special.normal_cdf(z) == pytest.approx(
        jvm.NormalDistribution().cumulativeProbability(z), abs=1e-12)


def test_two_sided_and_unknown_alternatives():
    assert special.two_tails(0.9, "two-sided") == pytest.approx(0.2)
    assert special.two_tails(0.9, "larger") == pytest.approx(0.1)
    with pytest.raises(ValueError):
        special.two_tails(0.5, "sideways")


def test_rounding_rules(spark):
    df = spark.createDataFrame([(0.125,), (1.005,), (2.675,), (-0.125,)], "v double")
    assert [r[0] for r in df.select(half_up("v")).collect()] == [0.13, 1.01, 2.68, -0.13]
    assert [r[0] for r in df.select(half_even("v")).collect()] == [0.12, 1.0, 2.68, -0.12]


def test_division_by_zero_is_null(spark):
    row = spark.range(1).select(
        quotient(F.lit(1), F.lit(0)).alias("q"), percent(F.lit(3), F.lit(0)).alias("p")).first()
    assert row["q"] is None and row["p"] is None


def test_levene_by_hand(spark):
    a, b = [1.0, 2.0, 4.0, 9.0], [3.0, 3.5, 4.0, 8.0, 30.0]
    df = spark.createDataFrame([("a", x) for x in a] + [("b", x) for x in b], "g string, x double")
    got = stats.levene(df, "g", "x", ["a", "b"]).first()
    za = [abs(x - 3.0) for x in a]
    zb = [abs(x - 4.0) for x in b]
    ma, mb = sum(za) / 4, sum(zb) / 5
    grand = (sum(za) + sum(zb)) / 9
    between = 4 * (ma - grand) ** 2 + 5 * (mb - grand) ** 2
    within = sum((z - ma) ** 2 for z in za) + sum((z - mb) ** 2 for z in zb)
    assert got["f_stat"] == pytest.approx(between / (within / 7), rel=1e-12)
    assert math.isclose(got["p_value"], special.f_sf(got["f_stat"], 1, 7))


def test_rounding_happens_once(spark):
    from tallyframe.functions.numeric import half_even, half_up

    df = spark.createDataFrame([(0.1249999999, 2.4999999, 2.675, 0.125, 1e25, float("nan"))], "a double, b double, c double, d double, e double, f double")
    row = df.select(
        half_up("a"), half_up("b", 0), half_up("c"), half_up("d"), half_even("d"), half_up("e"), half_up("f")
    ).first()
    assert row[:6] == (0.12, 2.0, 2.68, 0.13, 0.12, 1e25) and math.isnan(row[6])


def test_describe_leaves_not_a_number_out(spark):
    from tallyframe.operators.profile import describe

    df = spark.createDataFrame([(1.0,), (3.0,), (float("nan"),), (None,)], "v double")
    row = describe(df, "v").first()
    assert (row["count"], row["mean"], row["var"], row["max"], row["q50"]) == (2, 2.0, 2.0, 3.0, 2.0)
    for value in (1e-12, 1e19):
        tiny = spark.createDataFrame([(value,), (value,)], "v double")
        assert describe(tiny, "v").first()["mean"] == value


def test_levene_does_not_cancel(spark):
    from tallyframe.operators.stats import levene

    rng = np.random.default_rng(3)
    for offset in (1e4, 1e9):
        x = {g: rng.choice([-1, 1], 2000) * (offset + rng.normal(0, s, 2000)) for g, s in (("a", 1.0), ("b", 1.2))}
        df = spark.createDataFrame([(g, float(v)) for g in x for v in x[g]], "g string, x double")
        z = {g: np.abs(v - np.median(v)) for g, v in x.items()}
        whole = np.concatenate(list(z.values()))
        middle = whole.mean()
        between = sum(len(v) * (v.mean() - middle) ** 2 for v in z.values())
        within = sum(((v - v.mean()) ** 2).sum() for v in z.values())
        row = levene(df, "g", "x", ["a", "b"]).first()
        assert row["f_stat"] == pytest.approx(between / (within / 3998), rel=1e-3)


def test_chi_square_of_large_counts(spark):
    from tallyframe.operators.association import chi_square

    n = 4_000_000_000
    table = spark.createDataFrame(
        [("c", "p", "u", n), ("c", "q", "w", n)], "column_name string, x string, y string, n long")
    row = chi_square(table).first()
    assert row["chi2"] == pytest.approx(2 * n) and row["cramers_v"] == pytest.approx(1)
