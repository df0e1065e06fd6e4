"""Skew-safe ranks and quantiles against pandas / numpy."""

import numpy as np
import pandas as pd
import pytest

from hearth.operators.order_stats import exact_quantiles, prefix_counts, with_average_rank
from hearth.operators.training import label_codes, with_positions


def test_rank_ties_pct(spark):
    df = spark.createDataFrame([("s", 1, 1.0), ("s", 1, 2.0), ("s", 1, 2.0), ("s", 1, 3.0)], "g string, d int, v double")
    out = with_average_rank(df, ["g", "d"], "v", pct=True, out="r").orderBy("v").collect()
    assert [r["r"] for r in out] == [0.25, 0.625, 0.625, 1.0]


def test_null_group_gives_null_rank(spark):
    df = spark.createDataFrame([(None, 1.0), ("a", 2.0), ("a", 3.0)], "g string, v double")
    out = {r["v"]: r["r"] for r in with_average_rank(df, ["g"], "v", out="r").collect()}
    assert out[1.0] is None and out[2.0] == 1.0 and out[3.0] == 2.0


def test_rank_matches_pandas_across_many_partitions(spark):
    rng = np.random.default_rng(7)
    pdf = pd.DataFrame({"g": rng.integers(0, 3, 400), "v": rng.integers(0, 40, 400).astype(float)})
    pdf.loc[pdf.index[:200], "g"] = 0  # one hot group: half of the rows
    df = spark.createDataFrame(pdf)
    got = with_average_rank(df, ["g"], "v", ascending=False, out="r", num_partitions=7).toPandas()
    exp = pdf.assign(r=pdf.groupby("g")["v"].rank(ascending=False, method="average"))
    m = got.merge(exp.drop_duplicates(), on=["g", "v"], suffixes=("", "_e"))
    assert np.allclose(m["r"], m["r_e"])


def test_exact_quantiles_match_numpy(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"g": rng.integers(0, 4, 500), "v": rng.normal(100, 20, 500).round(1)})
    df = spark.createDataFrame(pdf)
    got = exact_quantiles(df, ["g"], "v", {"q25": 0.25, "med": 0.5, "q75": 0.75}, num_partitions=5).toPandas()
    for _, row in got.iterrows():
        vals = pdf.loc[pdf.g == row.g, "v"]
        assert np.isclose(row.med, vals.quantile(0.5))
        assert np.isclose(row.q25, vals.quantile(0.25)) and np.isclose(row.q75, vals.quantile(0.75))


def test_global_positions(spark):
    df = spark.range(0, 1000).selectExpr("id % 37 AS a", "id AS b")
    out = prefix_counts(df, [], ["a", "b"], num_partitions=6).toPandas().sort_values(["a", "b"])
    assert list(out["_before"]) == list(range(1000))
    assert set(out["_total"]) == {1000}


def test_global_group_stats_without_join(spark):
    from hearth.operators.order_stats import group_stats
    pdf = pd.DataFrame({"v": [1.0, 2.0, 4.0, 10.0]})
    r = group_stats(spark.createDataFrame(pdf), [], "v", stats=("mean", "median", "count")).collect()[0]
    assert r["mean"] == 4.25 and r["median"] == 3.0 and r["count"] == 4


@pytest.fixture
def no_reuse(spark):
    was = spark.conf.get("spark.sql.exchange.reuse")
    spark.conf.set("spark.sql.exchange.reuse", "false")
    yield
    spark.conf.set("spark.sql.exchange.reuse", was)


def test_prefix_counts_do_not_need_exchange_reuse(spark, no_reuse):
    """Above the range sampler's sample size, where two runs of the exchange cut differently."""
    n = 120_000
    rng = np.random.default_rng(11)
    pdf = pd.DataFrame({"g": np.where(rng.random(n) < 0.4, "hot", rng.integers(0, 9, n).astype(str)), "v": rng.normal(size=n).round(4),
                        "Date": rng.integers(0, 300, n), "RegionName": rng.integers(0, 2000, n).astype(str)})
    df = spark.createDataFrame(pdf).repartition(6)
    ranks = pdf.groupby("g")["v"].rank(method="average").sum()
    medians = pdf.groupby("g")["v"].median()
    codes = {v: i for i, v in enumerate(sorted(pdf.RegionName.unique()))}
    for _ in range(2):
        got = with_average_rank(df, ["g"], "v", out="r", num_partitions=9).agg({"r": "sum"}).first()[0]
        assert np.isclose(got, ranks, rtol=0, atol=1e-3)
        q = {r["g"]: r["m"] for r in exact_quantiles(df, ["g"], "v", {"m": 0.5}, num_partitions=9).collect()}
        assert all(np.isclose(q[g], m) for g, m in medians.items())
        pos = with_positions(df.select("Date", "RegionName")).toPandas().sort_values("position")
        assert list(pos["position"]) == list(range(n))
        assert pos[["Date", "RegionName"]].equals(pos[["Date", "RegionName"]].sort_values(["Date", "RegionName"], kind="stable"))
        assert {r["value"]: r["code"] for r in label_codes(df, ["RegionName"]).collect()} == codes
