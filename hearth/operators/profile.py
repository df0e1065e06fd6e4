"""Profiling, quality checks, top-k, set operations and correlations
(AGG-1..9, AGG-13..19, SRT-2..4, SET-1..4, JN-8/9).

Functions that only print in the reference return their rows here. Every
grouped median is exact and skew-safe (``order_stats``); distinct counts use
Spark's two-level distinct aggregation; top-k uses ``orderBy().limit()``, which
plans as a distributed TakeOrderedAndProject (k rows per task, then a merge).
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearth.functions.exprs import DAYS_PER_MONTH
from hearth.operators.order_stats import exact_quantiles, group_stats, value_runs
from hearth.schema import DatasetRegistry
from hearth.session import materialize

# Fixed values of the reference's quality thresholds.
MISSING_PCT_FLAG = 10.0
OUTLIER_PCT_FLAG = 5.0
IQR_K = 1.5
SPACING_FLAG_MONTHS = 2.0
CORRELATION_FLAG = 0.7
HISTOGRAM_BINS = 50
TOP_K = 10


def dataset_overview(df: DataFrame, by: str = "Dataset") -> DataFrame:
    """AGG-1: rows, distinct regions, date range, missing values, min/max/median."""
    base = df.groupBy(by).agg(
        F.count(F.lit(1)).alias("Total_Rows"),
        F.countDistinct("RegionName").alias("Unique_Regions"),
        F.min("Date").alias("Date_Min"),
        F.max("Date").alias("Date_Max"),
        F.count_if(F.col("Value").isNull()).alias("Missing_Values"),
        F.min("Value").alias("Min_Value"),
        F.max("Value").alias("Max_Value"),
    ).withColumn("Missing_Pct", F.col("Missing_Values") / F.col("Total_Rows") * F.lit(100.0))
    med = exact_quantiles(df, [by], "Value", {"Median_Value": 0.5})
    return base.join(med, [by], "left")


def dataset_summary(df: DataFrame, registry: DatasetRegistry | None = None, by: str = "Dataset") -> DataFrame:
    """AGG-2: rows, non-null values, regions, date and value ranges, plus the
    registry's description and geography (a fixed 4-row table, broadcast)."""
    spark = df.sparkSession
    registry = registry or DatasetRegistry()
    meta = spark.createDataFrame([(n, d, g) for _, n, d, g in registry.as_rows()],
                                 f"{by} string, Description string, Geography string")
    agg = df.groupBy(by).agg(
        F.count(F.lit(1)).alias("Rows"),
        F.count("Value").alias("Non_Null_Values"),
        F.countDistinct("RegionName").alias("Unique_Regions"),
        F.min("Date").alias("Date_Range_Start"),
        F.max("Date").alias("Date_Range_End"),
        F.min("Value").alias("Value_Range_Min"),
        F.max("Value").alias("Value_Range_Max"),
    )
    return agg.join(F.broadcast(meta), [by], "left")


def value_describe(df: DataFrame, by: Sequence[str] = ("Dataset",), value: str = "Value") -> DataFrame:
    """AGG-3: pandas ``describe()``: count, mean, std, min, quartiles, max."""
    by = list(by)
    v = F.col(value)
    base = df.groupBy(*by).agg(F.count(v).cast("double").alias("count"), F.avg(v).alias("mean"),
                               F.stddev_samp(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"))
    q = exact_quantiles(df, by, value, {"p25": 0.25, "p50": 0.5, "p75": 0.75})
    return base.join(q, by, "left").select(*by, "count", "mean", "std", "min", "p25", "p50", "p75", "max")


def monthly_trend(df: DataFrame, volume: bool = False, by: str = "Dataset") -> DataFrame:
    """AGG-4 (mean, median, count) / AGG-5 (mean, median, sum) per dataset and month."""
    stats = ("mean", "median", "sum") if volume else ("mean", "median", "count")
    return group_stats(df, [by, "Date"], "Value", stats=stats)


def trend_headline(monthly: DataFrame, back: int = 60, by: str = "Dataset") -> DataFrame:
    """AGG-6: latest monthly median, the median ``back`` rows from the end (the
    reference's ``iloc[-60]``), their % change and the number of months. The
    window runs over the per-month table (one row per month)."""
    from pyspark.sql import Window
    w = Window.partitionBy(by).orderBy(F.col("Date").desc())
    m = monthly.withColumn("_k", F.row_number().over(w))
    out = m.groupBy(by).agg(
        F.count(F.lit(1)).alias("points"),
        F.max(F.when(F.col("_k") == 1, F.col("Date"))).alias("latest_date"),
        F.max(F.when(F.col("_k") == 1, F.col("median"))).alias("latest_median"),
        F.max(F.when(F.col("_k") == back, F.col("median"))).alias("median_back"),
    )
    return out.withColumn("change_pct", (F.try_divide("latest_median", "median_back") - F.lit(1.0)) * F.lit(100.0))


def volume_headline(monthly: DataFrame, by: str = "Dataset") -> DataFrame:
    """AGG-7: latest monthly total and the peak monthly total."""
    return monthly.groupBy(by).agg(
        F.max("Date").alias("latest_date"),
        F.max_by("sum", "Date").alias("latest_total"),
        F.max("sum").alias("peak_total"),
    )


def state_coverage(home: DataFrame) -> DataFrame:
    """AGG-8: per state distinct regions, observations, median value, all rounded
    half-to-even to 0 decimals (pandas ``round(0)``)."""
    agg = home.where(F.col("StateName").isNotNull()).groupBy("StateName").agg(
        F.countDistinct("RegionName").alias("Unique_Regions"), F.count("Value").alias("Total_Observations"))
    med = exact_quantiles(home, ["StateName"], "Value", {"Median_Value": 0.5})
    return agg.join(med, ["StateName"], "left").withColumn("Median_Value", F.bround("Median_Value", 0))


def metro_inventory_stats(inventory: DataFrame) -> DataFrame:
    """AGG-9: per region mean, max, std of inventory, rounded half-to-even to 0."""
    return inventory.where(F.col("RegionName").isNotNull()).groupBy("RegionName").agg(
        F.bround(F.avg("Value"), 0).alias("Avg_Inventory"),
        F.bround(F.max("Value"), 0).alias("Peak_Inventory"),
        F.bround(F.stddev_samp("Value"), 0).alias("Volatility"),
    )


def top_k(df: DataFrame, by: str, key: str, k: int = TOP_K, ascending: bool = False) -> DataFrame:
    """SRT-2/3: top k by ``by`` (ties broken by ``key``), a distributed TakeOrdered."""
    order = F.col(by).asc() if ascending else F.col(by).desc()
    return df.orderBy(order, F.col(key).asc()).limit(k)


def latest_snapshot(df: DataFrame, date: str = "Date") -> DataFrame:
    """Rows at the table's own latest date (scalar subquery, no join)."""
    return df.where(F.col(date) == df.select(F.max(date)).scalar())


def latest_price_to_rent(home: DataFrame, rent: DataFrame) -> DataFrame:
    """JN-8 rows: each panel at its own latest date, inner-joined on region."""
    h = latest_snapshot(home).select("RegionName", F.col("Value").alias("HomeValue"))
    r = latest_snapshot(rent).select("RegionName", F.col("Value").alias("Rent"))
    return h.join(r, "RegionName").select(
        "RegionName", "HomeValue", "Rent", F.try_divide(F.col("HomeValue"), F.col("Rent") * F.lit(12.0)).alias("ratio"))


def price_to_rent_summary(ratios: DataFrame) -> DataFrame:
    """JN-8: count, exact median, min, max of the latest ratios (one aggregate
    over the distinct-value counts that the exact median builds anyway)."""
    return exact_quantiles(ratios, [], "ratio", {"median_ratio": 0.5}, extras=True).select(
        F.col("_count").alias("regions"), F.col("_min").alias("min_ratio"), F.col("_max").alias("max_ratio"),
        "median_ratio")


def extreme_ratios(ratios: DataFrame, k: int = TOP_K) -> DataFrame:
    """SRT-4 + SET-1: k smallest UNION ALL k largest ratios, tagged."""
    lo = ratios.orderBy(F.col("ratio").asc(), "RegionName").limit(k).withColumn("side", F.lit("lowest"))
    hi = ratios.orderBy(F.col("ratio").desc(), "RegionName").limit(k).withColumn("side", F.lit("highest"))
    return lo.unionByName(hi)


def histogram(df: DataFrame, col: str, bins: int = HISTOGRAM_BINS) -> DataFrame:
    """AGG-19: equal-width bins between min and max (max falls in the last bin),
    every bin present (empty bins count 0)."""
    spark = df.sparkSession
    low = df.select(F.min(col)).scalar()
    high = df.select(F.max(col)).scalar()
    flat = high == low  # one value only: half a unit of room on either side
    lo = F.when(flat, low - F.lit(0.5)).otherwise(low)
    width = F.when(flat, F.lit(1.0)).otherwise(high - low)
    idx = F.least(F.floor((F.col(col) - lo) / width * F.lit(float(bins))), F.lit(bins - 1)).cast("int")
    counts = df.where(F.col(col).isNotNull()).groupBy(idx.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    # the 50 bin ids are the histogram's own axis, not data
    axis = spark.range(bins).select(F.col("id").cast("int").alias("bin"))
    out = axis.join(counts, "bin", "left").select(
        "bin",
        (lo + width * F.col("bin").cast("double") / F.lit(float(bins))).alias("bin_start"),
        (lo + width * (F.col("bin") + 1).cast("double") / F.lit(float(bins))).alias("bin_end"),
        F.coalesce(F.col("count"), F.lit(0)).cast("long").alias("count"),
    )
    return out.where(low.isNotNull())


def common_regions(a: DataFrame, b: DataFrame, key: str = "RegionName") -> DataFrame:
    """SET-2: INTERSECT of the region keys of two datasets."""
    return a.select(key).intersect(b.select(key))


def distinct_dates(df: DataFrame, n: int = 10, by: str = "Dataset") -> DataFrame:
    """SET-4: first n distinct dates per dataset, ordered."""
    from pyspark.sql import Window
    d = df.select(by, "Date").distinct()
    w = Window.partitionBy(by).orderBy("Date")
    return d.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= n).drop("_k")


def sample_rows(df: DataFrame, n: int = 10, order: Sequence[str] = ("RegionName", "Date")) -> DataFrame:
    """SRC-8: first n rows in a stable order (TakeOrderedAndProject)."""
    return df.orderBy(*order).limit(n)


# --- quality (AGG-13..17) --------------------------------------------------------------------------------------

def null_rates(df: DataFrame, by: str = "Dataset") -> DataFrame:
    """AGG-13: % NULL per column per dataset in one pass, then unpivoted."""
    cols = [c for c in df.columns if c != by]
    agg = df.groupBy(by).agg(F.count(F.lit(1)).alias("_rows"),
                             *[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    long = agg.unpivot([by, "_rows"], cols, "column", "nulls")
    return long.select(by, "column", (F.col("nulls") / F.col("_rows") * F.lit(100.0)).alias("missing_pct")) \
        .withColumn("flagged", F.col("missing_pct") > F.lit(MISSING_PCT_FLAG))


def iqr_outliers(df: DataFrame, by: str = "Dataset", value: str = "Value") -> DataFrame:
    """AGG-14: exact Q1/Q3, count and % of rows outside [Q1 - 1.5 IQR, Q3 + 1.5 IQR]."""
    runs = value_runs(df, [by], value)
    q = exact_quantiles(df, [by], value, {"q1": 0.25, "q3": 0.75}, runs=runs)
    q = q.withColumns({"lower": F.col("q1") - F.lit(IQR_K) * (F.col("q3") - F.col("q1")),
                       "upper": F.col("q3") + F.lit(IQR_K) * (F.col("q3") - F.col("q1"))})
    # the fences are one row per dataset; they meet the distinct values and their counts, not the rows
    q = materialize(q, "fences")
    v = F.col(value)
    outside = F.sum(F.when((v < F.col("lower")) | (v > F.col("upper")), F.col("_n")).otherwise(0))
    found = runs.join(q, [by]).groupBy(by, "q1", "q3", "lower", "upper").agg(outside.alias("outliers"))
    rows = df.where(F.col(by).isNotNull()).groupBy(by).agg(F.count(F.lit(1)).alias("rows"))
    out = found.join(rows, [by]).select(by, "q1", "q3", "lower", "upper", "rows", "outliers")
    out = out.withColumn("outlier_pct", F.col("outliers") / F.col("rows") * F.lit(100.0))
    return out.withColumn("flagged", F.col("outlier_pct") > F.lit(OUTLIER_PCT_FLAG))


def duplicate_rows(df: DataFrame, by: str = "Dataset") -> DataFrame:
    """AGG-15 + SET-3: full-row copies after the first = rows - distinct rows."""
    per_row = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_c"))
    return per_row.groupBy(by).agg(
        F.sum("_c").alias("rows"), F.count(F.lit(1)).alias("distinct_rows"),
        F.sum(F.col("_c") - 1).alias("duplicates"),
    ).withColumn("flagged", F.col("duplicates") > 0)


def date_spacing(df: DataFrame, by: str = "Dataset", region: str = "RegionName") -> DataFrame:
    """AGG-16: mean over regions of (last - first date) / 30.44 / rows; flag > 2."""
    per = df.where(F.col(region).isNotNull()).groupBy(by, region).agg(
        (F.datediff(F.max("Date"), F.min("Date")).cast("double") / F.lit(DAYS_PER_MONTH)
         / F.count(F.lit(1)).cast("double")).alias("_gap"))
    out = per.groupBy(by).agg(F.avg("_gap").alias("avg_gap_months"))
    return out.withColumn("flagged", F.col("avg_gap_months") > F.lit(SPACING_FLAG_MONTHS))


def quality_report(df: DataFrame, by: str = "Dataset") -> DataFrame:
    """AGG-17: all checks as rows (Dataset, check, metric, flagged)."""
    nr = null_rates(df, by).select(by, F.concat(F.lit("missing_pct:"), F.col("column")).alias("check"),
                                   F.col("missing_pct").alias("metric"), "flagged")
    io = iqr_outliers(df, by).select(by, F.lit("outlier_pct").alias("check"), F.col("outlier_pct").alias("metric"),
                                     "flagged")
    du = duplicate_rows(df, by).select(by, F.lit("duplicate_rows").alias("check"),
                                       F.col("duplicates").cast("double").alias("metric"), "flagged")
    ds = date_spacing(df, by).select(by, F.lit("avg_gap_months").alias("check"),
                                     F.col("avg_gap_months").alias("metric"), "flagged")
    return nr.unionByName(io).unionByName(du).unionByName(ds)


# --- monthly wide table and correlations (JN-9, AGG-18) ---------------------------------------------------------

def monthly_wide(df: DataFrame, names: dict[str, str], by: str = "Dataset") -> DataFrame:
    """JN-9: per-dataset monthly mean/median/std side by side on Date.

    Equivalent to a chain of FULL OUTER JOINs on Date, planned as one grouped
    aggregate over the stacked datasets and a pivot on the (fixed, known)
    dataset names -- one shuffle instead of one per join."""
    stats = group_stats(df, [by, "Date"], "Value", stats=("mean", "median", "std"))
    stats = stats.withColumn(by, F.coalesce(*[F.when(F.col(by) == k, F.lit(v)) for k, v in names.items()]))
    aggs = [F.first(s, ignorenulls=True).alias(s) for s in ("mean", "median", "std")]
    wide = stats.groupBy("Date").pivot(by, list(names.values())).agg(*aggs)
    return wide.select("Date", *[f"{n}_{s}" for n in names.values() for s in ("mean", "median", "std")])


def metric_correlations(wide: DataFrame, threshold: float = CORRELATION_FLAG) -> DataFrame:
    """AGG-18: pairwise-complete Pearson correlation of every pair of metric
    columns (upper triangle) in one aggregate pass; pairs with |r| > threshold."""
    cols = [c for c in wide.columns if c != "Date"]
    pairs = list(combinations(cols, 2))
    agg = wide.agg(*[F.corr(a, b).alias(f"{i}") for i, (a, b) in enumerate(pairs)])
    stack = ", ".join(f"'{a}', '{b}', `{i}`" for i, (a, b) in enumerate(pairs))
    long = agg.selectExpr(f"stack({len(pairs)}, {stack}) as (metric_a, metric_b, correlation)")
    return long.where(F.abs(F.col("correlation")) > F.lit(threshold))
