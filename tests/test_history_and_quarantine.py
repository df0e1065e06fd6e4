"""Run history, quarantined lines, catalogue counts, streaming scores with saved models."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF001
from hearth.operators import history as H
from hearth.operators import models as M
from hearth.operators import scoring as sc
from hearth.operators import training as tr
from hearth.schema import LONG_SCHEMA
from hearth.sources import clean as C
from hearth.sources import panels as P
from hearth.streaming import requests as S

# --- quarantine -----------------------------------------------------------------------

GOOD = "{},1,r,zip,S,St,M,C,{},{},home,zip"


def test_every_line_is_a_row_or_a_reject(spark, tmp_path):
    lines = [(GOOD.format(1, "2020-01-01", "5.5"), ""), (GOOD.format(2, "3/1/2020", "6"), ""), (GOOD.format(3, "not-a-date", "7"), "date"),
             (GOOD.format(4, "2020-01-01", "n/a"), "value"), (GOOD.format(5, "soon", "x"), "date, value"), (GOOD.format(6, "2020-01-01", "8") + ",more", "fields"),
             ("7,1,short", "date, value, fields"), (GOOD.format("seven", "2020-01-01", "9"), "fields"), (GOOD.format(8, "", "9"), "date"), (GOOD.format(9, "2020-01-01", ""), "value"),
             (GOOD.format(10, "2020-01-01", "NaN"), "value"), (GOOD.format("", "2020-02-01", "10"), ""), (GOOD.format(11, "2020-01-01", '"1,5"'), "value"),
             (GOOD.format(12, " 2020-01-01 ", " 11 "), "")]
    (tmp_path / "in").mkdir()
    header = ",".join(LONG_SCHEMA.fieldNames())
    (tmp_path / "in" / "a.csv").write_text("\n".join([header, *[x for x, _ in lines[:5]]]) + "\n")
    (tmp_path / "in" / "b.csv").write_text("\n".join([header, *[x for x, _ in lines[5:]]]))
    rows, rejects = C.read_quarantined(spark, str(tmp_path / "in"))
    assert rows.schema.fieldNames() == LONG_SCHEMA.fieldNames() and dict(rows.dtypes)["Date"] == "date"
    got = {(r.RegionID, r.Date, r.Value) for r in rows.collect()}
    assert got == {(1, dt.date(2020, 1, 1), 5.5), (2, dt.date(2020, 3, 1), 6.0), (None, dt.date(2020, 2, 1), 10.0), (12, dt.date(2020, 1, 1), 11.0)}
    kept = rejects.collect()
    assert sorted(r.reason for r in kept) == sorted(why for _, why in lines if why)
    assert rows.count() + len(kept) == len(lines)
    assert {r.line for r in kept if "fields" in r.reason} == {x for x, why in lines if "fields" in why}


def test_quarantine_of_a_file_without_lines(spark, tmp_path):
    (tmp_path / "a.csv").write_text(",".join(LONG_SCHEMA.fieldNames()) + "\n")
    rows, rejects = C.read_quarantined(spark, str(tmp_path))
    assert rows.count() == rejects.count() == 0


# --- run history -----------------------------------------------------------------------


def scores(spark, *rows):
    return spark.createDataFrame([(t, m, 10, e, e, 0.5, 4) for t, m, e in rows], f"{H.METRICS}, depth int")


def test_runs_are_appended_replayed_and_compared(spark, tmp_path):
    log = H.RunLog(spark, str(tmp_path / "log"))
    assert log.rows().count() == 0 and H.latest_best(log.rows()).count() == 0
    first, second = scores(spark, ("t1", "a", 3.0), ("t1", "b", 2.0), ("t2", "a", 9.0)), scores(spark, ("t1", "a", 2.5), ("t1", "b", 4.0))
    log.commit("r1", "2024-01-01 00:00:00", first)
    log.commit("r2", "2024-02-01 00:00:00", second)
    log.commit("r2", "2024-02-01 00:00:00", second)  # replayed
    (tmp_path / "log" / "run=r3").mkdir()
    (tmp_path / "log" / "run=r3" / "part-0.parquet").write_bytes(b"broken off")
    rows = log.rows().collect()
    assert len(rows) == 5 and {r.run for r in rows} == {"r1", "r2"} and rows[0].params == '{"depth":4}'
    best = {r.target: (r.run, r.model, r.rmse) for r in H.latest_best(log.rows()).collect()}
    assert best == {"t1": ("r2", "a", 2.5), "t2": ("r1", "a", 9.0)}
    moved = {(r.model, r.run): (r.rmse_before, r.best_so_far) for r in H.changes(log.rows()).where("target = 't1'").collect()}
    assert moved == {("a", "r1"): (None, 3.0), ("a", "r2"): (3.0, 2.5), ("b", "r1"): (None, 2.0), ("b", "r2"): (2.0, 2.0)}
    with pytest.raises(ValueError):
        log.commit("a/b", "2024-01-01 00:00:00", first)


def test_a_run_that_broke_off_can_be_committed_again(spark, tmp_path):
    log = H.RunLog(spark, str(tmp_path))
    (tmp_path / "run=x").mkdir()
    (tmp_path / "run=x" / "part-0.parquet").write_bytes(b"broken off")
    log.commit("x", "2024-01-01 00:00:00", scores(spark, ("t", "m", 1.0)))
    assert log.rows().count() == 1


# --- catalogue ---------------------------------------------------------------------------


def test_type_counts_and_total(spark):
    df = spark.createDataFrame([(1.0, None, 3.0, "x")], "Value_lag_1 double, Value_lag_2 double, Month double, Metro_mean string")
    got = {r.Type: (r.features, r.non_null) for r in tr.feature_type_counts(tr.feature_catalogue(df)).collect()}
    assert got == {"temporal": (2, 1), "time": (1, 1), "geographic": (1, 1), tr.TOTAL: (4, 3)}


# --- streaming scores with saved models ------------------------------------------------------


def test_stream_scores_with_a_saved_bundle_equal_the_batch(spark):
    rng = np.random.default_rng(3)
    names = ["Value_lag_1", "Rent", "Month"]
    rows = [(f"r{i}", i, "train" if i < 150 else "test", *map(float, rng.normal(size=3) * 1000), float(rng.normal()), float(rng.normal())) for i in range(200)]
    made = spark.createDataFrame(rows, "RegionName string, Date int, split string, Value_lag_1 double, Rent double, Month double, t1 double, t3 double")
    mat = M.assembled(made, names, made.columns)
    loaded = []
    for t in ("t1", "t3"):
        models = {(t, "linear"): M.model_zoo(t)["linear"].fit(mat.where("split = 'train'"))}
        ev = M.metrics(M.predictions(models[t, "linear"], mat, t, "linear")).withColumn("best", F.lit(True))
        loaded.append(M.load_best(spark, M.save_best(ev, models, t, names, tr.scaler_statistics(mat, names))))
    f = sc.Forecasters(loaded[0][0].stages[-1], loaded[1][0].stages[-1], tuple(names), "linear", "linear")
    columns = ["request_id", "success", "error", "raw_1m", "raw_3m", "return_1m", "return_3m", "risk_category", "model_version", "return_1m_lower", "return_3m_upper"]
    stream = S.stream_score(spark, SF001, None, "2024-06-15", models=f).select(*columns)
    batch = sc.score(P.requests(spark, SF001), None, "2024-06-15", models=f).select(*columns)
    a, b = ({r.request_id: tuple(r) for r in d.collect()} for d in (stream, batch))
    assert a == b and len(a) == batch.count() and sum(r[1] for r in a.values()) > 50
