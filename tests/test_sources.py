"""Reading, writing, staging and the shape of the plans."""

import pytest
from pyspark.sql import functions as F

from tallyframe.plans import game, realty
from tallyframe.plans.registry import QUERIES
from tallyframe.sources import (
    catalog, catalog_columns, catalog_tables, load, read_bucketed, read_csv, read_dataset, staged,
    write_bucketed, write_dataset,
)
from tallyframe.sources.proxies import proxy
from tallyframe.sources.schemas import CSV_SCHEMAS, TableKeys, csv_schema


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_csv_scan_with_declared_schema(spark, tmp_path):
    (tmp_path / "e.csv").write_text(
        "user_id,event_dt,event_name,details\n"
        "u1,2020-12-01 10:00:00,registration,1.25\n"
        "u2,2020-12-01 11:30:00,login,ZONE_CODE03\n"
        "u2,2020-12-02 11:30:00,purchase,\n", encoding="utf-8")
    df = read_csv(spark, str(tmp_path), csv_schema("ab_test_events"))
    assert dict(df.dtypes)["event_dt"] == "timestamp_ntz"
    assert [r["details"] for r in df.orderBy("event_dt").collect()] == ["1.25", "ZONE_CODE03", None]


def test_bad_cells_raise(spark, tmp_path):
    (tmp_path / "p.csv").write_text("row_number,city,puid,hours\n0,m,1,many\n")
    with pytest.raises(Exception):
        read_csv(spark, str(tmp_path), csv_schema("online_library_data")).collect()


def test_all_declared_schemas_parse():
    assert all(len(csv_schema(name)) >= 4 for name in CSV_SCHEMAS)


def test_partitioned_hand_over_prunes(spark, tmp_path):
    df = spark.range(100).select("id", (F.col("id") % 4).alias("part"))
    write_dataset(df, str(tmp_path / "out"), ["part"])
    back = read_dataset(spark, str(tmp_path / "out"))
    assert back.count() == 100
    one = back.where(F.col("part") == 2)
    assert "PartitionFilters: [isnotnull(part" in plan_of(one)
    assert one.count() == 25


def test_staged_table_keeps_rows_and_schema(spark):
    df = spark.createDataFrame([(1, None), (2, "x")], "id long, s string")
    copy = staged(df, "copy")
    assert copy.dtypes == df.dtypes
    assert sorted(r["id"] for r in copy.collect()) == [1, 2]


def test_catalog(spark):
    spark.range(1).createOrReplaceTempView("some_view")
    try:
        names = [r["table_name"] for r in catalog_tables(spark).collect()]
        assert "some_view" in names
    finally:
        spark.catalog.dropTempView("some_view")
    rows = catalog_columns(spark.range(1).selectExpr("id", "'a' AS s"), "t").collect()
    assert [(r["position"], r["column_name"], r["data_type"]) for r in rows] == [
        (1, "id", "bigint"), (2, "s", "string")]


def test_catalog_names_every_constraint(spark):
    line = spark.createDataFrame([], "order_id long, line int, note string")
    order = spark.createDataFrame([], "order_id long")
    keys = {
        "line": TableKeys(("order_id", "line"), {"order_id": ("order", "order_id")}),
        "order": TableKeys(("order_id",)),
    }
    rows = catalog({"line": line, "order": order}, keys).collect()
    assert sorted((r["table_name"], r["position"], r["key_role"], r["parent_table"]) for r in rows
                  if r["key_role"]) == [
        ("line", 1, "foreign key", "order"), ("line", 1, "primary key", None),
        ("line", 2, "primary key", None), ("order", 1, "primary key", None)]
    assert [r["column_name"] for r in rows if not r["key_role"]] == ["note"]


def test_bucketed_hand_over_is_joined_where_it_lies(spark, tmp_path):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = spark.range(1000).select((F.col("id") * 3).alias("k"), F.lit("x").alias("a b"))
        df = df.union(spark.sql("SELECT NULL, 'none'"))
        path = str(tmp_path / "handed")
        write_bucketed(df, path, "k", 4)
        back = read_bucketed(spark, path, df.schema, "k", 4)
        assert sorted(map(str, back.collect())) == sorted(map(str, df.collect()))
        assert back.columns == ["k", "a b"] and not spark.catalog.listTables(pattern="handed_*")
        joined = back.join(spark.range(300).withColumnRenamed("id", "k"), "k")
        assert joined.count() == 100
        assert plan_of(joined).count("Exchange") == 1
        assert plan_of(back.groupBy("k").count()).count("Exchange") == 0
        with pytest.raises(Exception):
            write_bucketed(df, path, "k", 4)
        empty = str(tmp_path / "empty")
        write_bucketed(df.limit(0), empty, "k", 4)
        assert read_bucketed(spark, empty, df.schema, "k", 4).count() == 0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_scans_read_only_needed_columns(spark, data_dir):
    df = game.payer_share(proxy(spark, data_dir, "g_users"))
    assert "ReadSchema: struct<c_custkey:bigint,c_acctbal:double>" in plan_of(df)


def test_limits_reach_the_scan_as_filters(spark, data_dir):
    listings = realty.staged_listings(
        proxy(spark, data_dir, "r_flats"), proxy(spark, data_dir, "r_advertisement"))
    plan = plan_of(realty.without_outliers(listings))
    assert "PushedFilters: [IsNotNull(price_1m), LessThan(price_1m" in plan


@pytest.mark.parametrize("name", sorted(set(QUERIES) - {"event_files", "city_handoff", "month_handoff"}))
def test_plans_avoid_pair_products(spark, data_dir, name):
    plan = plan_of(QUERIES[name](spark, data_dir))
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan
    assert "BatchEvalPython" not in plan


def test_load_reads_one_table(spark, data_dir):
    assert load(spark, data_dir, "region").count() == 5


def test_quoted_cells_hold_quotes_commas_and_line_breaks(spark, tmp_path):
    from pyspark.sql.types import StructType

    from tallyframe.sources.files import read_csv

    (tmp_path / "a.csv").write_text(
        'id,price,avg_bill\n1,"кафе ""Ромашка""","He said ""x"", y"\n2,"line\nbreak",\n', encoding="utf-8")
    schema = StructType.fromDDL("id int, price string, avg_bill string")
    rows = [tuple(r) for r in read_csv(spark, str(tmp_path / "a.csv"), schema).collect()]
    assert rows == [(1, 'кафе "Ромашка"', 'He said "x", y'), (2, "line\nbreak", None)]
    (tmp_path / "b.csv").write_text("id,avg_bill,price\n1,a,b\n", encoding="utf-8")
    with pytest.raises(Exception, match="(?i)header"):
        read_csv(spark, str(tmp_path / "b.csv"), schema).collect()


def test_retention_bound_reaches_the_scan(spark, tmp_path):
    from tallyframe.plans import library

    spark.createDataFrame([(1, "2024-12-02"), (1, "2024-12-05"), (2, "2024-11-01")], "puid long, msk_business_dt_str string").write.parquet(str(tmp_path / "a"))
    df = library.daily_retention(spark.read.parquet(str(tmp_path / "a")))
    assert "GreaterThanOrEqual(msk_business_dt_str,2024-12-02)" in df._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r)[:2] for r in df.collect()] == [(0, 1), (3, 1)]
