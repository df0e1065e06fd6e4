"""Geographic features (JN-5..7, WIN-9/10, AGG-12, ML-1).

State and metro statistics are whole-history aggregates (as in the reference,
they see the future); their medians are exact and skew-safe (order_stats).
Both ranks are computed from pre-aggregated counts, never by a window over a
whole state or a whole month.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearth.operators.order_stats import average_rank_table, group_stats, prefix_counts, with_average_rank
from hearth.session import materialize, together

STAT_NAMES = ("mean", "median", "std", "count")


def state_stats(df: DataFrame, key: str = "StateName", value: str = "Value", prefix: str = "State_") -> DataFrame:
    """Per-key mean, exact median, sample std and count over all dates."""
    return group_stats(df, [key], value, prefix=prefix, stats=STAT_NAMES)


def join_state_stats(df: DataFrame, key: str = "StateName", prefix: str = "State_") -> DataFrame:
    """JN-5 / JN-6: LEFT JOIN the per-key statistics (one row per state or metro)."""
    stats = state_stats(df, key, prefix=prefix)
    cnt = f"{prefix}count"
    return df.join(stats, [key], "left").withColumn(cnt, F.col(cnt).cast("double"))


def state_rank_table(df: DataFrame, key: str = "StateName", date: str = "Date", value: str = "Value") -> DataFrame:
    """WIN-9 as a (Date, StateName) -> StateRank table.

    State_count is the state's count of non-NULL values over all dates, repeated on
    each of its rows; per date the rows are ranked by it, descending, ties averaged.
    That rank only depends on how many rows each state has per date, so it is computed
    on the (date, state) count table -- #dates x #states rows -- never on the rows."""
    from pyspark.sql import Window
    per = df.where(F.col(key).isNotNull() & F.col(date).isNotNull()).groupBy(date, key).agg(
        F.count(F.lit(1)).alias("_n"), F.count(F.col(value)).alias("_v"))
    per = per.withColumn("State_count", F.sum("_v").over(Window.partitionBy(key)).cast("double"))
    by_count = per.groupBy(date, "State_count").agg(F.sum("_n").alias("_tie"))
    w = Window.partitionBy(date).orderBy(F.col("State_count").desc()).rowsBetween(Window.unboundedPreceding, -1)
    ranks = by_count.withColumn("_before", F.coalesce(F.sum("_tie").over(w), F.lit(0))).select(
        date, "State_count",
        (F.col("_before").cast("double") + (F.col("_tie").cast("double") + F.lit(1.0)) / F.lit(2.0)).alias("StateRank"))
    return per.join(ranks, [date, "State_count"]).select(date, key, "StateRank")


def with_state_rank(df: DataFrame) -> DataFrame:
    """WIN-9: average-tie descending rank of State_count among the rows of each date
    (rows, not states, are ranked -- the reference's behaviour)."""
    return df.join(state_rank_table(df), ["Date", "StateName"], "left")


def with_value_rank_in_state(df: DataFrame) -> DataFrame:
    """WIN-10: average-tie percentile rank of Value within (StateName, Date)."""
    return with_average_rank(df, ["StateName", "Date"], "Value", pct=True, out="ValueRankInState")


def region_profiles(df: DataFrame, region: str = "RegionName", value: str = "Value") -> DataFrame:
    """AGG-12: per-region mean, std, min, max; NULL becomes 0."""
    v = F.col(value)
    return df.where(F.col(region).isNotNull()).groupBy(region).agg(
        F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"),
    ).fillna(0.0, subset=["mean", "std", "min", "max"])


# The reference's largest number of clusters; it is the default at every data size.
CLUSTER_K = 10


def geo_clusters(df: DataFrame, region: str = "RegionName", value: str = "Value", k: int = CLUSTER_K,
                 seed: int = 42) -> DataFrame:
    """ML-1: k-means of the (unscaled) region profiles, as (region, Cluster).

    ``k`` is a plain parameter (the reference takes a cluster per 100 regions, at most
    10, and skips small tables); the same path runs at every size and the column
    always exists. No region gives an empty table; fewer distinct profiles than ``k``
    give fewer clusters."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    if k < 2:
        raise ValueError("k-means needs k >= 2")
    profiles = region_profiles(df, region, value)
    feats = VectorAssembler(inputCols=["mean", "std", "min", "max"], outputCol="_features").transform(profiles)
    feats = materialize(feats.select(region, "_features"), "kmeans-input")  # re-read by every iteration
    found = feats.select("_features").distinct().limit(k).count()
    if found < 2:  # no profile, or one: nothing to tell apart
        return feats.select(region, F.lit(0).alias("Cluster"))
    model = KMeans(k=min(k, found), seed=seed, featuresCol="_features", predictionCol="Cluster").fit(feats)
    return model.transform(feats).select(region, F.col("Cluster").cast("int"))


def fused_order_stats(df: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """State median, metro median and the value rank in (state, date) from ONE
    prefix-count pass: the three (group, value) count tables are stacked under a
    kind tag and range-partitioned together, instead of three separate
    range-partition / window / offset pipelines."""
    v = F.col("Value")
    base = df.where(v.isNotNull() & ~F.isnan(v))
    parts = [
        base.where(F.col("StateName").isNotNull()).select(
            F.lit("s").alias("_kind"), F.col("StateName").alias("_k1"), F.lit("").alias("_k2"), "Value"),
        base.where(F.col("Metro").isNotNull()).select(
            F.lit("m").alias("_kind"), F.col("Metro").alias("_k1"), F.lit("").alias("_k2"), "Value"),
        base.where(F.col("StateName").isNotNull() & F.col("Date").isNotNull()).select(
            F.lit("r").alias("_kind"), F.col("StateName").alias("_k1"), F.col("Date").cast("string").alias("_k2"),
            "Value"),
    ]
    stacked = parts[0].unionByName(parts[1]).unionByName(parts[2])
    counts = stacked.groupBy("_kind", "_k1", "_k2", "Value").agg(F.count(F.lit(1)).alias("_n"))
    # ranks, state medians and metro medians all read this table
    pc = materialize(prefix_counts(counts, ["_kind", "_k1", "_k2"], ["Value"], "_n"), "order-stats")
    rank = (F.col("_before").cast("double") + (F.col("_n").cast("double") + F.lit(1.0)) / F.lit(2.0)) \
        / F.col("_total").cast("double")
    ranks = pc.where(F.col("_kind") == "r").select(
        F.col("_k1").alias("StateName"), F.col("_k2").cast("date").alias("Date"), "Value",
        rank.alias("ValueRankInState"))
    pos = (F.col("_total") - F.lit(1)).cast("double") * F.lit(0.5)
    lo, hi = F.floor(pos), F.ceil(pos)
    start, stop = F.col("_before"), F.col("_before") + F.col("_n")
    med = pc.where(F.col("_kind") != "r").groupBy("_kind", "_k1").agg(
        F.max(F.when((start <= lo) & (lo < stop), v)).alias("_lo"),
        F.max(F.when((start <= hi) & (hi < stop), v)).alias("_hi"),
        F.max(pos - lo.cast("double")).alias("_t"))
    med = med.select("_kind", "_k1", (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_t")).alias("_median"))
    state_med = med.where(F.col("_kind") == "s").select(F.col("_k1").alias("StateName"),
                                                        F.col("_median").alias("State_median"))
    metro_med = med.where(F.col("_kind") == "m").select(F.col("_k1").alias("Metro"),
                                                        F.col("_median").alias("Metro_median"))
    return state_med, metro_med, ranks


def _simple_stats(df: DataFrame, key: str, prefix: str) -> DataFrame:
    v = F.col("Value")
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(
        F.avg(v).alias(f"{prefix}mean"), F.stddev_samp(v).alias(f"{prefix}std"),
        F.count(v).cast("double").alias(f"{prefix}count"))


def geographic_features(df: DataFrame, with_clusters: bool = True, cluster_k: int = CLUSTER_K, onto: DataFrame | None = None) -> DataFrame:
    """The reference's ``create_geographic_features``; ``onto`` may name some of the rows of ``df``
    (with further columns), which then alone get the statistics of all of them.

    Every statistics and rank table is derived from the same input rows and written
    before it is joined: their sizes are then known, so the planner broadcasts the
    small ones (states, metros, dates x states, clusters) without moving the wide
    side, and takes a sort-merge join beyond the limit. Only the value-rank table
    usually needs a shuffle of the rows. The exact medians and the value rank share
    one prefix-count pass (``fused_order_stats``)."""
    has_metro = "Metro" in df.columns
    if has_metro:
        state_med, metro_med, ranks = fused_order_stats(df)
        state = _simple_stats(df, "StateName", "State_").join(state_med, "StateName", "left")
    else:
        state = state_stats(df, "StateName", prefix="State_")
        ranks = average_rank_table(df, ["StateName", "Date"], "Value", pct=True, out="ValueRankInState")
    state = state.withColumn("State_count", F.col("State_count").cast("double"))
    # tables that do not need each other are written at the same time
    jobs = [lambda: materialize(state.select("StateName", "State_mean", "State_median", "State_std", "State_count"), "states"),
            lambda: materialize(state_rank_table(df), "state-ranks"), lambda: materialize(ranks, "value-ranks")]
    keys = [["StateName"], ["Date", "StateName"], ["StateName", "Date", "Value"]]
    if has_metro:
        metro = _simple_stats(df, "Metro", "Metro_").join(metro_med, "Metro", "left")
        jobs.insert(1, lambda: materialize(metro.select("Metro", "Metro_mean", "Metro_median", "Metro_std", "Metro_count"), "metros"))
        keys.insert(1, ["Metro"])
    if with_clusters:
        jobs.append(lambda: materialize(geo_clusters(df, k=cluster_k), "clusters"))
        keys.append(["RegionName"])
    out = df if onto is None else onto
    for table, key in zip(together(*jobs), keys):
        out = out.join(table, key, "left")
    if with_clusters:
        out = out.withColumn("GeographicCluster", F.coalesce(F.col("Cluster"), F.lit(-1)).cast("int")).drop("Cluster")
    return out
