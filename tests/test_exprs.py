"""Hand-sized frames for the scalar rules (FIXTURES.md section 3)."""

import datetime as dt

from pyspark.sql import functions as F

from hearth.functions.exprs import direction, market_era, return_category, round_half_up, safe_div


def test_category_edges(spark):
    df = spark.createDataFrame([(-5.0,), (-1.0,), (1.0,), (5.0,), (-5.01,), (None,)], "r double")
    got = [r[0] for r in df.select(return_category("r")).collect()]
    assert got == [1, 2, 3, 4, 0, None]


def test_direction_unknown_future_is_zero(spark):
    df = spark.createDataFrame([(0.5,), (0.0,), (-1.0,), (None,)], "r double")
    assert [r[0] for r in df.select(direction("r")).collect()] == [1, 0, 0, 0]


def test_era_edges(spark):
    days = [dt.date(2007, 12, 31), dt.date(2008, 1, 1), dt.date(2012, 1, 1), dt.date(2020, 1, 1), dt.date(2022, 1, 1)]
    df = spark.createDataFrame([(d,) for d in days], "Date date")
    got = [r[0] for r in df.select(market_era("Date")).collect()]
    assert got == ["pre_crisis", "crisis_recovery", "post_crisis", "covid_boom", "post_covid"]


def test_zero_denominator_is_null(spark):
    df = spark.createDataFrame([(1.0, 0.0), (1.0, None), (3.0, 2.0)], "a double, b double")
    assert [r[0] for r in df.select(safe_div("a", "b")).collect()] == [None, None, 1.5]


def test_round_half_up_is_plain_ieee(spark):
    df = spark.createDataFrame([(1.23456,), (-1.23455,), (2.5,)], "x double")
    got = [r[0] for r in df.select(round_half_up(F.col("x"), 4)).collect()]
    assert got == [1.2346, -1.2345, 2.5]
