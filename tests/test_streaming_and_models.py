"""Stream = batch for the request-log streams; invariants for the MLlib models."""

from pyspark.sql import functions as F

from conftest import SF001, SF01
from hearth.operators import geographic as geo
from hearth.operators import models as M
from hearth.sources import panels as P
from hearth.streaming import requests as S


def test_daily_counts_stream_equals_batch(spark):
    stream = {(r["window_start"], r["kind"]): r["count"] for r in S.stream_daily_counts(spark, SF001).collect()}
    log = P.request_log(spark, SF001)
    batch = log.groupBy(F.date_format(F.date_trunc("day", "ts"), "yyyy-MM-dd HH:mm:ss").alias("d"), "kind").count()
    assert stream == {(r["d"], r["kind"]): r["count"] for r in batch.collect()}


def test_kmeans_clusters_cover_every_region(spark):
    home = P.home_panel(spark, SF01)
    c = geo.geo_clusters(home, k=3)
    rows = c.collect()
    assert len(rows) == home.select("RegionName").distinct().count()
    assert {r["Cluster"] for r in rows} <= {0, 1, 2}
    again = {r["RegionName"]: r["Cluster"] for r in geo.geo_clusters(home, k=3).collect()}
    assert again == {r["RegionName"]: r["Cluster"] for r in rows}  # same seed, same result


def test_metrics_r2_bounded(spark):
    df = spark.createDataFrame([("t", "m", 1.0, 1.5), ("t", "m", 2.0, 1.0), ("t", "m", 3.0, 3.5)],
                               "target string, model string, y double, pred double")
    r = M.metrics(df).collect()[0]
    assert r["r2"] <= 1.0 and r["rmse"] >= r["mae"] >= 0


def test_param_draws_are_seeded():
    assert M.draw_params(3) == M.draw_params(3)


def test_clusters_exist_at_every_size(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("b", 9.0)], "RegionName string, Value double")
    rows = geo.geo_clusters(df).collect()
    assert {r["RegionName"] for r in rows} == {"a", "b"}
    assert geo.geo_clusters(df.limit(0)).columns == ["RegionName", "Cluster"]


def test_state_rank_counts_values(spark):
    rows = [("a", "d1", 1.0), ("a", "d2", None), ("a", "d2", None), ("b", "d1", 1.0), ("b", "d2", 2.0)]
    df = spark.createDataFrame(rows, "StateName string, Date string, Value double")
    got = {(r["StateName"], r["Date"]): r["StateRank"] for r in geo.state_rank_table(df).collect()}
    # b has two values, a one: b leads on both dates; a's two rows of d2 share ranks 2 and 3
    assert got == {("b", "d1"): 1.0, ("a", "d1"): 2.0, ("b", "d2"): 1.0, ("a", "d2"): 2.5}


def test_stream_reads_its_own_table_only(spark, tmp_path):
    spark.read.parquet(f"{SF001}/events.parquet").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    want = spark.read.parquet(f"{SF001}/events.parquet").count()
    spark.read.parquet(f"{SF001}/events.parquet").write.parquet(str(tmp_path / "events_old.parquet"))
    assert sum(r["count"] for r in S.stream_daily_counts(spark, str(tmp_path)).collect()) == want


def test_histogram_of_one_value(spark):
    from hearth.operators.profile import histogram
    rows = histogram(spark.createDataFrame([(2.0,)] * 3, "x double"), "x", 10).collect()
    assert sum(r["count"] for r in rows) == 3 and min(r["bin_start"] for r in rows) == 1.5 and max(r["bin_end"] for r in rows) == 2.5


def test_iqr_outliers_match_pandas(spark):
    import numpy as np
    import pandas as pd
    from hearth.operators.profile import iqr_outliers
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"Dataset": rng.choice(["a", "b"], 400), "Value": rng.standard_t(2, 400).round(1)})
    got = {r["Dataset"]: (r["rows"], r["outliers"]) for r in iqr_outliers(spark.createDataFrame(pdf)).collect()}
    for d, v in pdf.groupby("Dataset")["Value"]:
        q1, q3 = v.quantile(0.25), v.quantile(0.75)
        assert got[d] == (len(v), int(((v < q1 - 1.5 * (q3 - q1)) | (v > q3 + 1.5 * (q3 - q1))).sum()))


def test_scratch_is_removed(spark):
    import os
    from hearth.session import materialize, scratch
    with scratch(spark):
        df = materialize(spark.range(3), "gone")
        path = df.inputFiles()[0].removeprefix("file://")
        assert df.count() == 3 and os.path.exists(path)
    assert not os.path.exists(path)


def test_shared_folder_is_required_on_a_cluster():
    from types import SimpleNamespace
    import pytest
    from hearth.session import checkpoint_root
    fake = SimpleNamespace(sparkContext=SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077"),
                           conf=SimpleNamespace(get=lambda k, d: d))
    with pytest.raises(RuntimeError):
        checkpoint_root(fake)


def test_jobs_together_keep_their_order_and_raise():
    import time
    import pytest
    from hearth.session import together
    assert together(lambda: time.sleep(0.2) or 1, lambda: 2, lambda: 3) == [1, 2, 3] and together() == []
    with pytest.raises(ZeroDivisionError):
        together(lambda: 1, lambda: 1 / 0)
