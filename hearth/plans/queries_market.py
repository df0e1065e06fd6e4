"""Registered queries: market joins, geographic statistics and ranks, the full
feature table and the training rows (SURVEY 2.4, 2.5 AGG-10..12, 2.6 WIN-9/10, 2.9)."""

from __future__ import annotations

from pyspark.sql import functions as F

from hearth.operators import geographic as geo
from hearth.operators import market as mk
from hearth.plans import oracle as O
from hearth.plans.features import FEATURE_TABLE_COLUMNS, feature_table, market_panel
from hearth.plans.registry import register
from hearth.session import materialize
from hearth.sources import panels as P

KEY = ["RegionName", "Date", "Value"]
#: The feature table without the cluster ids, which no SQL can name.
CHECKED_COLUMNS = [c for c in FEATURE_TABLE_COLUMNS if c != "GeographicCluster"]
KEY_SQL = "RegionName, Date, " + O.rnd("Value") + " AS Value"


def _market_query(name, cols, doubles):
    sql = O.with_market(f"SELECT {KEY_SQL}, " + ", ".join(
        f"{O.rnd(c)} AS {c}" if c in doubles else c for c in cols) + " FROM market")

    @register(name, sql)
    def _q(spark, sf):
        return market_panel(spark, sf).select(*KEY, *cols)
    return _q


_market_query("join_rent", ["Rent"], {"Rent"})
_market_query("price_rent_metrics", ["Rent", "PriceToRentRatio", "RentAffordabilityRatio", "PriceRentSpread"],
              {"Rent", "PriceToRentRatio", "RentAffordabilityRatio", "PriceRentSpread"})
_market_query("join_state_inventory", ["StateName", "State_Inventory_Mean", "State_Inventory_Total"],
              {"State_Inventory_Mean", "State_Inventory_Total"})
_market_query("join_state_sales", ["StateName", "State_Sales_Mean", "State_Sales_Total"],
              {"State_Sales_Mean", "State_Sales_Total"})
_market_query("market_velocity", ["StateName", "MonthsOfSupply", "MarketLiquidity"],
              {"MonthsOfSupply", "MarketLiquidity"})
_market_query("join_national", ["National_mean", "National_median", "National_std"],
              {"National_mean", "National_median", "National_std"})
_market_query("value_vs_national", ["ValueVsNational", "ValueVsNationalMedian"],
              {"ValueVsNational", "ValueVsNationalMedian"})
_market_query("market_panel", [c for c in O.LONG_COLS if c not in KEY] + O.MARKET_COLS, set(O.MARKET_COLS))


@register("state_month_volume", O.with_panels(
    "SELECT 'inventory' AS Panel, StateName, Date, " + O.rnd("avg(Value)") + " AS State_Mean, "
    + O.rnd("sum(Value)") + " AS State_Total FROM inventory WHERE StateName IS NOT NULL GROUP BY StateName, Date "
    "UNION ALL SELECT 'sales' AS Panel, StateName, Date, " + O.rnd("avg(Value)") + " AS State_Mean, "
    + O.rnd("sum(Value)") + " AS State_Total FROM sales WHERE StateName IS NOT NULL GROUP BY StateName, Date",
    "inventory", "sales"))
def state_month_volume(spark, sf):
    out = None
    for name in ("inventory", "sales"):
        t = mk.state_month_volume(P.panel(spark, sf, name), "X").select(
            F.lit(name).alias("Panel"), "StateName", "Date",
            F.col("State_X_Mean").alias("State_Mean"), F.col("State_X_Total").alias("State_Total"))
        out = t if out is None else out.unionByName(t)
    return out


@register("national_by_month", O.with_panels(
    "SELECT Date, " + O.rnd("avg(Value)") + " AS National_mean, " + O.rnd("median(Value)") + " AS National_median, "
    + O.rnd("stddev_samp(Value)") + " AS National_std FROM home GROUP BY Date", "home"))
def national_by_month(spark, sf):
    return mk.national_by_month(materialize(P.home_panel(spark, sf).select("Date", "Value")))


def _stats_sql(key, p):
    return O.with_panels(
        f"SELECT {key}, {O.rnd('avg(Value)')} AS {p}_mean, {O.rnd('median(Value)')} AS {p}_median, "
        f"{O.rnd('stddev_samp(Value)')} AS {p}_std, CAST(count(Value) AS DOUBLE) AS {p}_count "
        f"FROM home WHERE {key} IS NOT NULL GROUP BY {key}", "home")


@register("state_stats", _stats_sql("StateName", "State"))
def state_stats(spark, sf):
    return geo.state_stats(materialize(P.home_panel(spark, sf).select("StateName", "Value")), "StateName", prefix="State_").withColumn(
        "State_count", F.col("State_count").cast("double"))


@register("metro_stats", _stats_sql("Metro", "Metro"))
def metro_stats(spark, sf):
    return geo.state_stats(materialize(P.home_panel(spark, sf).select("Metro", "Value")), "Metro", prefix="Metro_").withColumn(
        "Metro_count", F.col("Metro_count").cast("double"))


@register("region_profiles", O.with_panels(
    "SELECT RegionName, " + ", ".join(
        f"{O.rnd(f'coalesce({fn}(Value), 0)')} AS {n}"
        for n, fn in (("mean", "avg"), ("std", "stddev_samp"), ("min", "min"), ("max", "max")))
    + " FROM home WHERE RegionName IS NOT NULL GROUP BY RegionName", "home"))
def region_profiles(spark, sf):
    return geo.region_profiles(P.home_panel(spark, sf))


@register("geo_clusters")
def geo_clusters(spark, sf):
    """ML-1 (rows-only: cluster ids are arbitrary; tests hold its invariants)."""
    return geo.geo_clusters(P.home_panel(spark, sf))


def _geo_cols_sql():
    return ", ".join(f"{O.rnd(c)} AS {c}" for c in O.GEO_COLS)


@register("geographic_features", O.with_panels(
    "," + O.geo_body("home") + f"\nSELECT {KEY_SQL}, StateName, Metro, {_geo_cols_sql()} FROM geo", "home"))
def geographic_features(spark, sf):
    # cluster ids are arbitrary and are left out of what SQL checks (see geo_clusters)
    df = geo.geographic_features(materialize(P.home_panel(spark, sf)), with_clusters=False)
    return df.select(*KEY, "StateName", "Metro", *O.GEO_COLS)


# --- the whole chain -------------------------------------------------------------------------------------------

_INT_COLS = {"RegionID", "SizeRank", "Year", "Month", "Quarter", "DayOfYear", "WeekOfYear", "GeographicCluster"}
_STR_COLS = {"RegionName", "RegionType", "StateName", "State", "Metro", "CountyName", "Dataset", "GeographyLevel",
             "MarketEra", "Date"}


def _feature_doubles(cols):
    return {c for c in cols if c not in _INT_COLS and c not in _STR_COLS
            and not c.startswith(("target_direction", "target_category"))}


def _calendar_sql():
    return (", CAST(year(Date) AS INTEGER) AS Year, CAST(month(Date) AS INTEGER) AS Month, "
            "CAST(quarter(Date) AS INTEGER) AS Quarter, CAST(dayofyear(Date) AS INTEGER) AS DayOfYear, "
            "CAST(weekofyear(Date) AS INTEGER) AS WeekOfYear, "
            "sin(2 * pi() * month(Date) / 12.0) AS Month_sin, cos(2 * pi() * month(Date) / 12.0) AS Month_cos, "
            "sin(2 * pi() * quarter(Date) / 4.0) AS Quarter_sin, cos(2 * pi() * quarter(Date) / 4.0) AS Quarter_cos, "
            f"{O.months_since_sql('geo')}, {O.ERA_SQL} AS MarketEra")


def feature_table_sql(where: str = "", rounded: bool = True) -> str:
    f = {n: O.frame(n) for n in (3, 12, 24)}
    derived = [
        ("Value_momentum_short", f"avg(Value) OVER {f[3]} / nullif(avg(Value) OVER {f[12]}, 0)"),
        ("Value_momentum_long", f"avg(Value) OVER {f[12]} / nullif(avg(Value) OVER {f[24]}, 0)"),
        ("Value_volatility_3m", f"stddev_samp(Value) OVER {f[3]} / nullif(avg(Value) OVER {f[3]}, 0)"),
        ("Value_volatility_12m", f"stddev_samp(Value) OVER {f[12]} / nullif(avg(Value) OVER {f[12]}, 0)"),
    ]
    win = O.lag_exprs() + O.rolling_exprs() + O.change_exprs() + derived + O.trend_exprs() + O.target_exprs()
    body = (f",\n{O.geo_body('market')},\n"
            f"t0 AS (SELECT geo.*{_calendar_sql()}, row_number() OVER ({O.W}) AS _rn FROM geo),\n"
            "t1 AS (SELECT t0.*,\n  "
            + ",\n  ".join(f"{e} AS {n}" for n, e in win) + "\nFROM t0)\n")
    cols = CHECKED_COLUMNS
    doubles = _feature_doubles(cols) if rounded else set()
    sel = ", ".join(f"{O.rnd(c)} AS {c}" if c in doubles else c for c in cols)
    return O.with_market(body + f"SELECT {sel} FROM t1 {where}")


@register("feature_table", feature_table_sql())
def feature_table_q(spark, sf):
    """TRN-4: market -> temporal -> geographic -> targets (cluster ids: see geo_clusters)."""
    return feature_table(spark, sf, with_clusters=False)


@register("training_rows", feature_table_sql(
    "WHERE target_value_1m IS NOT NULL AND target_value_3m IS NOT NULL AND target_value_6m IS NOT NULL "
    "AND target_value_12m IS NOT NULL"))
def training_rows_q(spark, sf):
    from hearth.operators.targets import training_rows
    return training_rows(feature_table(spark, sf, with_clusters=False))
