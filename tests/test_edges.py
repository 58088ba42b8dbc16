"""Small fixtures for the cases the large tables do not hold."""

import datetime as dt
import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from tallyframe.functions.numeric import within_or_null
from tallyframe.functions.temporal import elapsed_days, month_name, to_day
from tallyframe.functions.text import bill_middle, bucketed, labelled, zone_regions
from tallyframe.operators import clean, experiment, joins, metrics, profile, stats
from tallyframe.plans import abtest, game, hypothesis, library, places


def at(text):
    return dt.datetime.fromisoformat(text)


def test_one_event_buyers_never_divide_by_zero(spark):
    users = spark.createDataFrame([(1, 1), (2, 0), (3, 1)], "id long, payer int")
    rows = [(1, 1)] + [(2, 1), (2, 5)] + [(3, d) for d in range(1, 31)]
    events = spark.createDataFrame(
        [(i, u, dt.date(2024, 1, d), 10.0) for i, (u, d) in enumerate(rows)],
        "transaction_id long, id long, date date, amount double",
    )
    spark.conf.set("spark.sql.codegen.wholeStage", "false")
    try:
        gaps = {r["id"]: float(r["avg_duration_day"])
                for r in game.purchase_gaps(users, events, 2).collect()}
        tiers = game.purchase_frequency_tiers(users, events, min_events=2).collect()
        with pytest.raises(ValueError, match="at least 2"):
            game.purchase_frequency_tiers(users, events, min_events=1)
    finally:
        spark.conf.unset("spark.sql.codegen.wholeStage")
    assert gaps == {2: 4.0, 3: 1.0}
    assert [r["count_buy_user"] for r in tiers] == [1, 1]


def test_null_tolerant_bounds_are_strict(spark):
    df = spark.createDataFrame([(1,), (5,), (10,), (None,)], "v int")
    kept = df.where(within_or_null("v", F.lit(1), F.lit(10))).collect()
    assert sorted(str(r["v"]) for r in kept) == ["5", "None"]


def test_buckets_send_missing_values_to_the_last_label(spark):
    df = spark.createDataFrame([(30,), (31,), (400,), (None,)], "v int")
    got = [r[0] for r in df.select(bucketed("v", [30, 90], ["a", "b", "c"])).collect()]
    assert got == ["a", "b", "c", "c"]
    got = [r[0] for r in df.select(labelled("v", {30: "x"}, "other")).collect()]
    assert got == ["x", "other", "other", "other"]
    with pytest.raises(ValueError):
        bucketed("v", [1], ["a"])


@pytest.mark.parametrize("later, earlier, days", [
    ("2024-01-02T01:00:00", "2024-01-01T23:00:00", 0),
    ("2024-01-01T22:00:00", "2024-01-01T23:00:00", -1),
    ("2024-01-08T23:00:00", "2024-01-01T23:00:00", 7),
    ("2024-01-08T22:59:59.999999", "2024-01-01T23:00:00", 6),
    ("2023-12-31T23:00:00", "2024-01-01T23:00:00", -1),
    ("2024-03-01T00:00:00", "2024-02-28T00:00:01", 1),
])
def test_elapsed_days_floor(spark, later, earlier, days):
    df = spark.createDataFrame([(at(later), at(earlier))], "a timestamp_ntz, b timestamp_ntz")
    assert df.select(elapsed_days("a", "b")).first()[0] == days
    assert (at(later) - at(earlier)).days == days


@settings(max_examples=20, deadline=None, suppress_health_check=list(HealthCheck))
@given(pairs=st.lists(st.tuples(
    st.datetimes(dt.datetime(2023, 1, 1), dt.datetime(2025, 1, 1)),
    st.datetimes(dt.datetime(2023, 1, 1), dt.datetime(2025, 1, 1))), min_size=1, max_size=20))
def test_elapsed_days_equals_python(spark, pairs):
    df = spark.createDataFrame(pairs, "a timestamp_ntz, b timestamp_ntz").coalesce(1)
    assert [r[0] for r in df.select(elapsed_days("a", "b")).collect()] == [
        (a - b).days for a, b in pairs]


def _experiment(spark):
    participants = spark.createDataFrame(
        [(u, g, abtest.TARGET_TEST, "PC") for u, g in
         [(1, "A"), (2, "A"), (3, "B"), (4, "B"), (5, "B")]] + [(5, "A", abtest.RIVAL_TEST, "PC")],
        "user_id long, `group` string, ab_test string, device string",
    )
    rows = [
        (1, "2024-01-01T12:00:00", "product_page"),   # an hour before registration
        (1, "2024-01-01T13:00:00", "registration"),
        (1, "2024-01-08T12:59:59", "purchase"),        # day 6
        (2, "2024-01-01T00:00:00", "product_page"),    # never registers
        (2, "2024-01-02T00:00:00", "purchase"),
        (3, "2024-01-01T00:00:00", "registration"),
        (3, "2024-01-01T00:00:00", "registration"),    # duplicate
        (3, "2024-01-08T00:00:00", "purchase"),        # day 7, too late
        (5, "2024-01-01T00:00:00", "registration"),    # also in the rival test
    ]
    events = spark.createDataFrame(
        [(u, at(t), e, "x") for u, t, e in rows],
        "user_id long, event_dt timestamp_ntz, event_name string, details string",
    )
    return participants, events


def test_lifetime_window(spark):
    participants, events = _experiment(spark)
    kept = {(r["user_id"], r["event_name"], r["time_after_reg"])
            for r in abtest.lifetime_events(participants, events).collect()}
    assert kept == {
        (1, "product_page", -1), (1, "registration", 0), (1, "purchase", 6),
        (3, "registration", 0),
    }


def test_milestones_agree_with_the_event_rows(spark):
    participants, events = _experiment(spark)
    by_rows = experiment.conversion(
        abtest.lifetime_events(participants, events), "group", "user_id",
        F.col("event_name") == "purchase")
    by_user = abtest.conversion_by_group(participants, events).drop("diff_cr")
    assert sorted(map(tuple, by_rows.collect())) == sorted(map(tuple, by_user.collect()))
    assert sorted(map(tuple, by_user.collect())) == [("A", 1, 1, 100.0), ("B", 1, 0, 0.0)]


@settings(max_examples=10, deadline=None, suppress_health_check=list(HealthCheck))
@given(a=st.sets(st.integers(0, 12), max_size=10), b=st.sets(st.integers(0, 12), max_size=10))
def test_overlap_identity(spark, a, b):
    rows = [(i, "a") for i in a] + [(i, "b") for i in b] + [(None, "a"), (99, "c")]
    df = spark.createDataFrame(rows, "id long, g string")
    row = joins.overlap(df, "id", F.col("g") == "a", F.col("g") == "b").first()
    assert tuple(row) == (len(a - b), len(b - a), len(a & b))
    assert sum(row) == len(a | b)


def test_drop_ambiguous_removes_every_member(spark):
    df = spark.createDataFrame(
        [("m", 1, 2.0), ("s", 1, 3.0), ("m", 2, 1.0), ("s", 3, None), ("s", 3, None)],
        "city string, puid long, hours double",
    )
    assert [tuple(r) for r in clean.drop_ambiguous(df, "puid").collect()] == [("m", 2, 1.0)]
    shares = hypothesis.city_shares(df).collect()
    assert [tuple(r) for r in shares] == [("m", 1, 100.0)]


def test_keep_first_takes_the_lowest_id_and_all_columns(spark):
    df = spark.createDataFrame(
        [(3, "a", "x", 7), (1, "a", "x", None), (2, "b", None, 5), (9, "b", None, 1)],
        "id long, name string, address string, seats int",
    )
    got = clean.dedupe_first(df, ["name", "address"], "id").orderBy("id").collect()
    assert [(r["id"], r["name"], r["address"], r["seats"]) for r in got] == [
        (1, "a", "x", None), (2, "b", None, 5)]
    assert profile.duplicate_count(df, ["name", "address"]).first()["duplicates"] == 2


def test_left_join_keeps_places_without_prices(spark):
    info = spark.createDataFrame([(1, "a"), (2, "b")], "id long, name string")
    price = spark.createDataFrame([(2, "low"), (3, "high")], "id long, price string")
    assert [tuple(r) for r in places.merge_price(info, price).collect()] == [(2, 2, 1)]


def test_null_groups_are_left_out_of_means(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), (None, 9.0)], "k string, v double")
    got = metrics.group_means_with_total(df, "k", "v", "m", "t").collect()
    assert [tuple(r) for r in got] == [("a", 1.5, 4.0)]
    assert [tuple(r) for r in profile.value_counts(df, "k").collect()] == [("a", 2)]


def test_value_shares_and_matrix(spark):
    df = spark.createDataFrame([("x", 0), ("x", 1), ("y", 1), ("y", None)], "k string, f int")
    shares = {r["f"]: r["share"] for r in profile.value_shares(df, "f").collect()}
    assert shares == {1: pytest.approx(2 / 3), 0: pytest.approx(1 / 3)}
    matrix = {r["k"]: (r["f0"], r["f1"])
              for r in profile.share_matrix(df, "k", "f", [0, 1], "f").collect()}
    assert matrix == {"x": (0.5, 0.5), "y": (0.0, 1.0)}


def test_pivot_count_leaves_empty_cells_null(spark):
    df = spark.createDataFrame([("x", 0, 1), ("x", 0, 2), ("y", 1, None)], "k string, f int, id int")
    got = {r["k"]: (r["f0"], r["f1"])
           for r in profile.pivot_count(df, "k", "f", "id", [0, 1], "f").collect()}
    assert got == {"x": (2, None), "y": (None, None)}


def test_missing_values_include_nan(spark):
    df = spark.createDataFrame([(1.0, "a"), (float("nan"), None), (None, "c")], "v double, s string")
    got = {r["column_name"]: (r["missing_count"], round(r["missing_percent"], 2))
           for r in profile.missing_report(df).collect()}
    assert got == {"v": (2, 66.67), "s": (1, 33.33)}


def test_keys_and_references(spark):
    parent = spark.createDataFrame([(1,), (2,), (2,), (None,)], "id long")
    child = spark.createDataFrame([(1,), (1,), (7,), (None,)], "ref long")
    assert tuple(profile.key_check(parent, ["id"]).first()) == (4, 2, 1, False)
    assert tuple(profile.fk_check(child, "ref", parent, "id").first()) == (3, 1)


def test_index_column(spark):
    def check(values):
        df = spark.createDataFrame([(v,) for v in values], "i long")
        return profile.index_column_check(df, "i").first()["is_row_number"]

    assert check([2, 0, 1]) and not check([0, 0, 2]) and not check([1, 2, 3])
    assert not check([0, 1, None])


def test_zone_codes(spark):
    df = spark.createDataFrame(
        [("ZONE_CODE00",), ("ZONE_CODE05",), ("ZONE_CODE15",), ("12.5",), (None,)], "d string")
    got = [r[0] for r in df.select(zone_regions("d")).collect()]
    assert got == [[], ["EU", "APAC"], ["EU", "CIS", "APAC", "N.America"], None, None]


def test_bill_ranges(spark):
    texts = ["Средний счёт: 1000–1500 ₽", "Средний счёт: от 500 ₽", "Цена бокала пива: 400–600 ₽",
             "Средний счёт", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(bill_middle("t", "Средний счёт")).collect()]
    assert got == [1250.0, 500.0, None, None, None]


def test_normalise_strips_every_white_space(spark):
    df = spark.createDataFrame([("\t Кафе \n",), (None,)], "name string")
    assert [r[0] for r in clean.normalise_text(df, ["name"]).collect()] == ["кафе", None]
    flags = clean.keyword_flag(
        spark.createDataFrame([("Ежедневно, КРУГЛОСУТОЧНО",), ("ежедневно",), (None,)], "h string"),
        "h", places.ROUND_THE_CLOCK, "f")
    assert [r["f"] for r in flags.collect()] == [1, 0, 0]


def test_dates_held_as_text(spark):
    df = spark.createDataFrame([("2024-12-02",), ("nonsense",)], "t string")
    assert [r[0] for r in df.select(to_day("t")).collect()] == [dt.date(2024, 12, 2), None]
    assert spark.range(1).select(month_name(F.lit(9))).first()[0] == "September"


def test_retention_counts_each_user_once_a_day(spark):
    rows = [(1, "2024-12-02"), (1, "2024-12-02"), (2, "2024-12-02"), (1, "2024-12-03"),
            (3, "2024-12-03"), (2, "2024-12-05"), (1, "2024-12-01")]
    df = spark.createDataFrame(rows, "puid long, msk_business_dt_str string")
    got = [tuple(r) for r in library.daily_retention(df).collect()]
    assert got == [(0, 2, 1.0), (1, 1, 0.5), (3, 1, 0.5)]


def test_histogram_like_the_usual_definition(spark):
    import numpy as np

    values = [0.0, 0.1, 0.2, 0.3, 0.6, 0.7, 0.7, 0.9, 1.0, 1.0]
    df = spark.createDataFrame([("g", v) for v in values] + [("one", 3.0), ("g", None)],
                               "k string, v double")
    got = stats.histogram(df, "v", 10, by=["k"]).where("k = 'g'").orderBy("bin").collect()
    counts, edges = np.histogram(values, 10)
    assert [r["count"] for r in got] == counts.tolist()
    assert [r["left_edge"] for r in got] == edges[:-1].tolist()
    assert sum(r["density"] * (r["right_edge"] - r["left_edge"]) for r in got) == pytest.approx(1)
    single = stats.histogram(df.where("k = 'one'"), "v", 4).where("count > 0").collect()
    assert [(r["bin"], r["count"]) for r in single] == [(2, 1)]


def test_box_stats(spark):
    df = spark.createDataFrame([(float(v),) for v in [1, 2, 3, 4, 100]], "v double")
    row = stats.box_stats(df, "v").first()
    assert (row["q25"], row["q50"], row["q75"]) == (2.0, 3.0, 4.0)
    assert (row["whisker_low"], row["whisker_high"], row["outliers"]) == (1.0, 4.0, 1)


def test_exclusion_keeps_rows_with_a_missing_id(spark):
    df = spark.createDataFrame([(1,), (2,), (None,)], "id long")
    ids = spark.createDataFrame([(2,), (None,)], "id long")
    assert sorted(str(r["id"]) for r in joins.exclude_ids(df, ids, "id").collect()) == ["1", "None"]
    assert [r["id"] for r in joins.keep_ids(df, ids, "id").collect()] == [2]


def test_first_event_joins_a_hot_user_without_a_hint(spark):
    rows = spark.range(3000).select(
        F.when(F.col("id") < 1200, 7).otherwise(F.col("id") % 100).alias("user"), "id")
    got = joins.with_first_event(rows, "user", F.col("user") != 5, "id", "first")
    first = rows.where("user != 5").groupBy("user").agg(F.min("id").alias("first"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, rows.join(first, "user").collect()))
    assert "hint" not in got._jdf.queryExecution().optimizedPlan().toString().lower()


def test_means_keep_more_than_two_decimals(spark):
    df = spark.createDataFrame([(0.00123,), (0.00456,)], "v double")
    assert profile.describe(df, "v").first()["mean"] == pytest.approx(0.002895, abs=1e-9)


def test_text_that_is_no_date_is_counted(spark):
    df = spark.createDataFrame([("2024-12-02",), ("2024-13-40",), (None,)], "msk_business_dt_str string")
    assert tuple(library.rejected_dates(df).first()) == (3, 1)


def test_index_column_is_found_and_dropped(spark):
    df = spark.range(5).select("id", (F.col("id") * 2).alias("v"))
    assert profile.drop_index_column(df, "id").columns == ["v"]


def test_a_transaction_of_two_users_counts_once_per_race(spark):
    users = spark.createDataFrame(
        [(1, 1, 0), (2, 1, 1), (3, 2, 0), (4, None, 0)], "id long, race_id long, payer long")
    race = spark.createDataFrame([(1, "elf"), (2, "orc")], "race_id long, race string")
    events = spark.createDataFrame(
        [(7, 1, 10.0), (7, 2, 5.0), (8, 3, 4.0), (7, 3, 2.0), (9, 4, 1.0), (9, 4, 0.0), (5, 2, 0.0), (6, 99, 3.0)],
        "transaction_id long, id long, amount double")
    got = {r["race"]: r for r in game.activity_by_dim(users, events, race).collect()}
    assert (got["elf"]["avg_event"], got["elf"]["avg_amount_event"], got["elf"]["avg_amount_user"]) == (1, 15.0, 7.5)
    assert (got["elf"]["count_total_user"], got["elf"]["count_buy_user"]) == (2, 2)
    assert (got["orc"]["avg_event"], got["orc"]["avg_amount_event"]) == (2, 3.0)
    assert (got[None]["avg_event"], got[None]["avg_amount_event"]) == (1, 1.0)


def test_amounts_beyond_the_decimals_are_summed_as_doubles(spark):
    users = spark.createDataFrame([(1, 1, 0)], "id long, race_id long, payer long")
    race = spark.createDataFrame([(1, "elf")], "race_id long, race string")
    events = spark.createDataFrame([(7, 1, 12345678901234567890.12)], "transaction_id long, id long, amount double")
    row = game.activity_by_dim(users, events, race).first()
    assert row["avg_amount_user"] == pytest.approx(12345678901234567890.12)
    assert game.payer_vs_nonpayer(users, events).first()["avg_amount_user"] == row["avg_amount_user"]


def _skewed(spark):
    rng = np.random.default_rng(8)
    values = [("a", float(v)) for v in rng.lognormal(3, 2, 400)] + [("b", float(v)) for v in rng.normal(-5, 9, 300)]
    values += [("a", 20.0)] * 350 + [("b", None), ("a", math.nan), ("b", math.nan), (None, 3.0), (None, 4.0)]
    return values, spark.createDataFrame(values, "k string, v double")


def _known(values, key):
    return np.array([v for k, v in values if k == key and v is not None and not math.isnan(v)])


def test_box_stats_like_rows_compared_one_by_one(spark):
    values, df = _skewed(spark)
    got = {r["k"]: r for r in stats.box_stats(df, "v", ["k"]).collect()}
    assert set(got) == {"a", "b", None}
    for key, row in got.items():
        x = _known(values, key)
        q25, q50, q75 = np.quantile(x, [0.25, 0.5, 0.75])
        low, high = q25 - 1.5 * (q75 - q25), q75 + 1.5 * (q75 - q25)
        inside = x[(x >= low) & (x <= high)]
        assert (row["count"], row["outliers"]) == (len(x), len(x) - len(inside))
        assert (row["whisker_low"], row["whisker_high"]) == (inside.min(), inside.max())
        assert [row["q25"], row["q50"], row["q75"]] == pytest.approx([q25, q50, q75], rel=1e-12)


def test_levene_like_rows_measured_one_by_one(spark):
    values, df = _skewed(spark)
    row = stats.levene(df, "k", "v", ["a", "b"]).first()
    groups = [np.abs(x - np.median(x)) for x in (_known(values, "a"), _known(values, "b"))]
    everything = np.concatenate(groups)
    between = sum(len(z) * (z.mean() - everything.mean()) ** 2 for z in groups)
    within = sum(((z - z.mean()) ** 2).sum() for z in groups)
    assert row["n_total"] == len(everything)
    assert row["f_stat"] == pytest.approx(between / (within / (len(everything) - 2)), rel=1e-9)


def test_welch_and_histogram_ignore_not_a_number(spark):
    values, df = _skewed(spark)
    clean = df.where("v is not null and not isnan(v)")
    assert stats.welch_ttest(df, "k", "v", "a", "b").first() == stats.welch_ttest(clean, "k", "v", "a", "b").first()
    few = spark.createDataFrame([(1.0,), (2.0,), (5.0,), (math.nan,), (None,)], "v double")
    got = stats.histogram(few, "v", 4).orderBy("bin").collect()
    assert [r["count"] for r in got] == [1, 1, 0, 1] and (got[0]["left_edge"], got[3]["right_edge"]) == (1, 5)


@pytest.mark.parametrize("make", [
    lambda df: stats.box_stats(df, "v", ["k"]), lambda df: stats.levene(df, "k", "v", ["a", "b"])])
def test_two_scans_are_enough(spark, tmp_path, make):
    _, df = _skewed(spark)
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    make(df.coalesce(1).mapInArrow(count, df.schema)).collect()
    assert seen.value == 2 * df.count()
