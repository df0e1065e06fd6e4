"""Wide files: header discovery, unpivot round trip, value-based detection, cleaning."""

import datetime as dt

import pytest

from conftest import SF001
from hearth.schema import DatasetInfo
from hearth.sources import clean as C
from hearth.sources import panels as P
from hearth.sources import wide as W

INFO = DatasetInfo("home_values", "zip", "home_wide.csv", "home", "test")


def test_header_rules():
    cols = ["RegionID", "regionname", "StateName", "2020-01-31", "1/31/2020", "notes", "2020-13-01"]
    assert W.geography_columns(cols) == ["RegionID", "regionname", "StateName"]
    assert W.month_columns(cols) == ["2020-01-31", "1/31/2020"]


def test_wide_round_trip(spark):
    home = P.home_panel(spark, SF001)
    back = W.wide_to_long(W.long_to_wide(home), INFO)
    key = ["RegionName", "Date", "Value"]
    assert sorted(map(tuple, back.select(*key).collect())) == sorted(map(tuple, home.select(*key).collect()))


def test_unpivot_drops_null_values_and_keeps_zip_text(spark):
    df = spark.createDataFrame([("00501", "1.5", None), ("90210", "n/a", "2.0")],
                               "RegionName string, `2020-01-31` string, `2020-02-29` string")
    out = {(r["RegionName"], r["Date"]): r["Value"] for r in W.wide_to_long(df, INFO).collect()}
    assert out == {("00501", dt.date(2020, 1, 31)): 1.5, ("90210", dt.date(2020, 2, 29)): 2.0}


def test_detect_date_columns_on_values(spark):
    out = {r["column_name"]: r["is_date"] for r in W.detect_date_columns(P.dirty_panel(spark, SF001)).collect()}
    assert out == {"Date": True, "Value": False, "Dataset": False, "GeographyLevel": False}


def test_clean_rejects_counts(spark):
    dirty = P.dirty_panel(spark, SF001)
    r = C.clean_rejects(dirty).collect()[0]
    assert r["rows_read"] == dirty.count()
    assert r["rows_kept"] == C.clean_long(dirty).count()
    assert r["invalid_dates"] + r["invalid_values"] + r["rows_kept"] == r["rows_read"]


def test_short_header_dates_keep_their_month(spark):
    df = spark.createDataFrame([("a", "1.0", "2.0")], "RegionName string, `2020-1-5` string, `3/4/2020` string")
    assert {r["Date"] for r in W.wide_to_long(df, INFO).collect()} == {dt.date(2020, 1, 5), dt.date(2020, 3, 4)}


def test_missing_file_is_skipped_and_a_damaged_one_raises(spark, tmp_path):
    assert W.ingest_wide_csv(spark, str(tmp_path), INFO) is None
    (tmp_path / INFO.file_path).write_bytes(b"x")
    (tmp_path / INFO.file_path).rename(tmp_path / "home_wide.csv.gz")
    broken = DatasetInfo("home_values", "zip", "home_wide.csv.gz", "home", "test")
    with pytest.raises(Exception):
        W.ingest_wide_csv(spark, str(tmp_path), broken).collect()


def test_long_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text("RegionName,Date,Value\nx,2020-01-31,1.5\ny,bad,2\nz,1/31/2020,\n")
    (tmp_path / "b.csv").write_text("RegionName,Value\nx,1\n")
    got = C.load_long(spark, {n: str(tmp_path / f"{n}.csv") for n in "abc"})
    assert set(got) == {"a"}
    assert [(r["RegionName"], r["Date"], r["Value"]) for r in got["a"].collect()] == [("x", dt.date(2020, 1, 31), 1.5)]
