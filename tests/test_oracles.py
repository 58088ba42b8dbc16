"""Every registered analysis against its SQL on whole tables."""

import pytest
from compare import assert_same, kinds

from tallyframe.oracles import oracle_sql
from tallyframe.plans.registry import QUERIES

SQL = oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, duck, data_dir, name):
    assert_same(QUERIES[name](spark, data_dir), duck, SQL[name])


def test_every_analysis_is_checked():
    assert set(SQL) <= set(QUERIES)
    assert set(QUERIES) == set(SQL)


def test_kinds_tell_types_apart():
    assert kinds({"a": "BIGINT", "b": "HUGEINT"}) == {"a": "int", "b": "huge"}


# The semantic traps show only without whole-stage code generation.
@pytest.mark.parametrize(
    "name", ["purchase_frequency_tiers", "activity_by_dim", "time_on_market_segments",
             "conversion_test", "clean_places"]
)
def test_matches_sql_without_codegen(spark, duck, data_dir, name):
    spark.conf.set("spark.sql.codegen.wholeStage", "false")
    try:
        assert_same(QUERIES[name](spark, data_dir), duck, SQL[name])
    finally:
        spark.conf.unset("spark.sql.codegen.wholeStage")
