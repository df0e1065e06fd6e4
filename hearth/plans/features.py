"""The feature chain (TRN-4): market panel -> geographic -> temporal -> targets.

Order of work differs from the reference's (temporal before geographic) only
where it saves a shuffle: the geographic statistics and ranks depend on
(StateName, Metro, Date, Value) alone, so they are joined onto the narrow market
panel first; the per-region windows of the temporal features and of the targets
then share one exchange and one sort. The output columns keep the reference's order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearth.operators import geographic as geo
from hearth.operators import market as mk
from hearth.operators import scoring as sc
from hearth.operators import targets as tg
from hearth.operators import temporal as tm
from hearth.schema import LONG_SCHEMA
from hearth.session import materialize, together
from hearth.sources import panels as P

MARKET_COLUMNS = ["Rent", "PriceToRentRatio", "RentAffordabilityRatio", "PriceRentSpread", "State_Inventory_Mean",
                  "State_Inventory_Total", "State_Sales_Mean", "State_Sales_Total", "MonthsOfSupply",
                  "MarketLiquidity", "National_mean", "National_median", "National_std", "ValueVsNational",
                  "ValueVsNationalMedian"]
GEOGRAPHIC_COLUMNS = ["State_mean", "State_median", "State_std", "State_count", "Metro_mean", "Metro_median",
                      "Metro_std", "Metro_count", "StateRank", "ValueRankInState", "GeographicCluster"]
TARGET_COLUMNS = tg.target_names()
FEATURE_TABLE_COLUMNS = (list(LONG_SCHEMA.fieldNames()) + MARKET_COLUMNS + tm.feature_names() + GEOGRAPHIC_COLUMNS
                         + TARGET_COLUMNS)


def market_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Home, rent and inventory come from one materialized (supplier, month)
    facts table -- one lineitem pass instead of three, and the home rows feed
    both the joined panel and the national statistics without a recomputation.
    Sales needs distinct orders per nation and month and reads lineitem itself."""
    facts, sales = together(lambda: materialize(P.supplier_month_facts(spark, sf_dir), "facts"),
                            lambda: materialize(P.sales_panel(spark, sf_dir), "sales"))
    return mk.market_panel(P.home_from_facts(facts, spark, sf_dir), P.rent_from_facts(facts, spark, sf_dir),
                           P.inventory_from_facts(facts, spark, sf_dir), sales)


def build_features(market: DataFrame, with_clusters: bool = True, cluster_k: int = geo.CLUSTER_K,
                   materialize_market: bool = True) -> DataFrame:
    """Feature table from any market-shaped long panel; the same columns at every size
    (``with_clusters=False`` leaves GeographicCluster out).

    The market panel feeds five branches (state and metro statistics, two rank
    tables, the cluster profiles) and the main window pass, so it is
    materialized once to the shared checkpoint folder: each branch reads it back
    instead of re-running the lineitem aggregations, the plan stays small, and a
    lost executor re-reads it instead of recomputing the lineage."""
    if materialize_market:
        market = materialize(market, "market")
    g = geo.geographic_features(market, with_clusters, cluster_k)
    # same rows as the market panel: take the global date bounds from the narrow base
    bounds = (market.select(F.min("Date")).scalar(), market.select(F.max("Date")).scalar())
    t = tm.temporal_features(g, bounds=bounds)
    t = tg.with_targets(t)
    return t.select(*[c for c in FEATURE_TABLE_COLUMNS if with_clusters or c != "GeographicCluster"])


def latest_features(market: DataFrame, as_of: str) -> DataFrame:
    """SCR-6: each region's last feature row of the day ``as_of`` or earlier, without targets and clusters:
    the same values as that row of ``build_features``. The windows run over the rows that it looks at,
    the statistics and ranks over the whole panel, and they meet one row a region."""
    market = materialize(market, "market")
    recent = tm.recent_rows(market.where(F.col("Date") <= F.lit(as_of).cast("date")))
    bounds = (market.select(F.min("Date")).scalar(), market.select(F.max("Date")).scalar())
    last = materialize(sc.latest_region_rows(tm.temporal_features(recent, bounds=bounds)), "latest")
    out = geo.geographic_features(market, with_clusters=False, onto=last)
    return out.select(*[c for c in FEATURE_TABLE_COLUMNS if c != "GeographicCluster" and c not in TARGET_COLUMNS])


def feature_table(spark: SparkSession, sf_dir: str, with_clusters: bool = True, cluster_k: int = geo.CLUSTER_K) -> DataFrame:
    return build_features(market_panel(spark, sf_dir), with_clusters, cluster_k)
