"""Label encoding, ordered split and scaling rules."""

import pandas as pd

from pyspark.sql import functions as F

from hearth.operators import training as tr


def test_label_encoding_order(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("B",)], "c string")
    codes = {r["value"]: r["code"] for r in tr.label_codes(df, ["c"]).collect()}
    assert codes == {"B": 0, "a": 1, "b": 2, "nan": 3}


def test_ordered_split_matches_positional_rule(spark):
    n = 137
    pdf = pd.DataFrame({"Date": pd.date_range("2000-01-01", periods=n, freq="D").date, "RegionName": "x"})
    out = tr.ordered_split(spark.createDataFrame(pdf)).toPandas()
    test_start = int(n * (1 - 0.2))
    val_start = int(test_start * (1 - 0.15))
    counts = out["split"].value_counts().to_dict()
    assert counts == {"train": val_start, "val": test_start - val_start, "test": n - test_start}
    assert sorted(out["position"]) == list(range(n))


def test_standardize_zero_variance_scales_by_one(spark):
    df = spark.createDataFrame([(1.0, 5.0, "train"), (3.0, 5.0, "train"), (10.0, 5.0, "test")], "a double, b double, split string")
    out = tr.standardize(df, ["a", "b"], F.col("split") == "train").collect()
    assert [r["a"] for r in out] == [-1.0, 1.0, 8.0]
    assert [r["b"] for r in out] == [0.0, 0.0, 0.0]


def test_catalogue_rule():
    assert tr.catalogue_type("Value_lag_1") == "temporal"
    assert tr.catalogue_type("State_mean") == "geographic"
    assert tr.catalogue_type("PriceToRentRatio") == "market_dynamics"
    assert tr.catalogue_type("MonthsOfSupply") == "market_dynamics"  # Supply wins over Month: rule order
    assert tr.catalogue_type("Quarter_sin") == "time"


def test_positions_keep_null_and_repeated_keys(spark):
    rows = [(1, "a", 1), (1, "a", 2), (2, None, 3), (None, "b", 4), (1, "a", 1)]
    out = tr.with_positions(spark.createDataFrame(rows, "Date int, RegionName string, x int")).collect()
    assert sorted(r["position"] for r in out) == [0, 1, 2, 3, 4] and {r["_n"] for r in out} == {5}
    assert sorted((r["x"] for r in out)) == [1, 1, 2, 3, 4]
    by = {r["x"]: r["position"] for r in out}
    assert by[4] == 0 and by[3] == 4


def test_labels_by_cut_are_those_of_the_positions(spark):
    rows = [(d, r, x) for d in (None, 1, 2, 3, 4, 5, 6) for r, x in ((None, 1), ("a", 2), ("a", 3), ("b", 4), ("c", 5))]
    for own in (rows, rows[5:12], rows[:1], [], [(1, "a", 1)] * 9, [*rows, *rows]):  # the last two: cuts between equal rows
        df = spark.createDataFrame(own, "Date int, RegionName string, x int")
        for sizes in ((0.2, 0.15), (0.37, 0.4), (0.0, 0.0)):
            want = sorted(map(repr, tr.ordered_split(df, *sizes).select("Date", "RegionName", "x", "split").collect()))
            assert sorted(map(repr, tr.split_labels(df, *sizes).select("Date", "RegionName", "x", "split").collect())) == want


def test_split_labels_move_no_rows(spark):
    df = spark.range(100).select(F.col("id").alias("Date"), F.col("id").cast("string").alias("RegionName"), F.lit("wide").alias("x"))
    plan = tr.split_labels(df)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_scaler_statistics_name_every_feature(spark):
    df = spark.createDataFrame([(1.0, None), (3.0, None)], "a double, b double")
    assert [tuple(r) for r in tr.scaler_statistics(df, ["b", "a"]).collect()] == [("b", 0.0, 1.0), ("a", 2.0, 1.0)]
    assert [tuple(r) for r in tr.scaler_statistics(df.limit(0), ["a", "b"]).collect()] == [("a", 0.0, 1.0), ("b", 0.0, 1.0)]
