"""Window features: hand-sized frames and a pandas differential test."""

import datetime as dt

import numpy as np
import pandas as pd

from hearth.operators import targets as tg
from hearth.operators import temporal as tm


def _panel(spark, rows):
    return spark.createDataFrame(rows, "RegionName string, Date date, Value double")


def test_partial_windows(spark):
    rows = [("r", dt.date(2020, m, 1), float(v)) for m, v in zip(range(1, 6), [10, 12, 11, 15, 14])]
    out = tm.with_window_features(_panel(spark, rows)).orderBy("Date").collect()
    assert out[0]["Value_rolling_mean_3"] == 10.0
    assert out[0]["Value_rolling_std_3"] is None
    assert out[0]["Value_trend_6"] is None and out[1]["Value_trend_6"] is None
    assert np.isclose(out[2]["Value_trend_6"], np.polyfit([0, 1, 2], [10, 12, 11], 1)[0])


def test_calendar_gap_is_row_based(spark):
    rows = [("r", dt.date(2020, 1, 1), 1.0), ("r", dt.date(2020, 2, 1), 2.0), ("r", dt.date(2020, 5, 1), 5.0)]
    out = tm.with_window_features(_panel(spark, rows)).orderBy("Date").collect()
    assert out[2]["Value_lag_1"] == 2.0


def test_last_rows_targets(spark):
    rows = [("r", dt.date(2000 + i // 12, i % 12 + 1, 1), 100.0 + i) for i in range(30)]
    out = tg.training_rows(tg.with_targets(_panel(spark, rows)))
    assert out.count() == 30 - 12
    last = tg.with_targets(_panel(spark, rows)).orderBy("Date").collect()[-1]
    assert last["target_direction_12m"] == 0 and last["target_category_12m"] is None


def test_differential_vs_pandas(spark):
    rng = np.random.default_rng(11)
    frames = []
    for r in range(4):
        n = int(rng.integers(20, 40))
        frames.append(pd.DataFrame({"RegionName": f"r{r}", "Date": pd.date_range("2001-01-01", periods=n, freq="MS"),
                                    "Value": rng.normal(1000, 50, n)}))
    pdf = pd.concat(frames).sort_values(["RegionName", "Date"]).reset_index(drop=True)
    sdf = spark.createDataFrame(pdf.assign(Date=pdf.Date.dt.date))
    got = tm.with_window_features(sdf).toPandas().sort_values(["RegionName", "Date"]).reset_index(drop=True)
    g = pdf.groupby("RegionName")["Value"]
    exp = {
        "Value_lag_3": g.shift(3),
        "Value_rolling_mean_6": g.rolling(6, min_periods=1).mean().reset_index(level=0, drop=True),
        "Value_rolling_std_12": g.rolling(12, min_periods=1).std().reset_index(level=0, drop=True),
        "Value_pct_change_6": g.pct_change(6),
        "Value_diff_12": g.diff(12),
        "Value_trend_6": g.rolling(6, min_periods=3).apply(
            lambda s: np.polyfit(np.arange(len(s)), s, 1)[0]).reset_index(level=0, drop=True),
    }
    for name, e in exp.items():
        assert np.allclose(got[name].astype(float), e.astype(float), equal_nan=True, rtol=1e-9), name


def test_reach_covers_every_feature():
    assert tm.DEFAULT.reach == 37
    assert tm.TemporalParams(lags=(1,), windows=(3,), changes=(2,), trends=(50,)).reach == 50


def test_recent_rows(spark):
    rows = [(r, dt.date(2000 + i // 12, i % 12 + 1, 1), float(i)) for r, n in (("a", 50), ("b", 3)) for i in range(n)]
    got = tm.recent_rows(_panel(spark, rows), rows=10).collect()
    assert sorted((r.RegionName, r.Value) for r in got) == [("a", float(i)) for i in range(40, 50)] + [("b", float(i)) for i in range(3)]
    assert tm.recent_rows(_panel(spark, [])).count() == 0


def test_latest_features_are_the_last_row_of_the_feature_table(spark):
    from hearth.operators import scoring as sc
    from hearth.plans import features as ft

    sf = "/root/testdata/sf0.001"
    for as_of in ("1995-02-10", "1999-06-15", "2030-01-01"):
        got = {r.RegionName: r for r in ft.latest_features(ft.market_panel(spark, sf), as_of).collect()}
        want = {r.RegionName: r for r in sc.latest_region_rows(ft.feature_table(spark, sf, with_clusters=False), as_of=as_of).collect()}
        assert got.keys() == want.keys() and len(got) == 10
        for region, row in got.items():
            for name, v in row.asDict().items():
                w = want[region][name]
                assert v == w or (isinstance(v, float) and isinstance(w, float) and np.isclose(v, w, rtol=1e-9, atol=1e-9)), (as_of, region, name, v, w)
