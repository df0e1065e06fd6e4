"""DuckDB SQL equivalents of the registered queries (the correctness oracle).

Written independently of the Spark plans: plain SQL over the driver's tables.
Doubles are rounded with the same IEEE formula on both sides (see
``hearth.functions.exprs.round_half_up``) so that engine-level summation-order
noise does not show up in a value hash.
"""

from __future__ import annotations

from hearth.operators.temporal import DEFAULT as TP
from hearth.operators.targets import HORIZONS


def rnd(expr: str, scale: int = 4) -> str:
    m = 10 ** scale
    return f"(floor(({expr}) * {m}.0 + 0.5) / {m}.0)"


HOME = """
SELECT CAST(s.s_suppkey AS BIGINT) AS RegionID, CAST(s.s_suppkey AS INTEGER) AS SizeRank,
       CAST(s.s_suppkey AS VARCHAR) AS RegionName, 'zip' AS RegionType, r.r_name AS StateName,
       substr(r.r_name, 1, 2) AS State, n.n_name AS Metro, s.s_name AS CountyName, a.Date AS Date,
       CAST(a.cents AS DOUBLE) / (CAST(100 AS DOUBLE) * CAST(a.n AS DOUBLE)) AS Value,
       'home_values' AS Dataset, 'zip' AS GeographyLevel
FROM (SELECT l_suppkey, CAST(date_trunc('month', l_shipdate) AS DATE) AS Date,
             SUM(CAST(round(l_extendedprice * 100) AS BIGINT)) AS cents, COUNT(*) AS n
      FROM lineitem GROUP BY 1, 2) a
JOIN supplier s ON a.l_suppkey = s.s_suppkey
JOIN nation n ON s.s_nationkey = n.n_nationkey
JOIN region r ON n.n_regionkey = r.r_regionkey
"""

RENT = """
SELECT CAST(s.s_suppkey AS BIGINT) AS RegionID, CAST(s.s_suppkey AS INTEGER) AS SizeRank,
       CAST(s.s_suppkey AS VARCHAR) AS RegionName, 'zip' AS RegionType, r.r_name AS StateName,
       substr(r.r_name, 1, 2) AS State, n.n_name AS Metro, s.s_name AS CountyName, a.Date AS Date,
       a.v AS Value, 'rents' AS Dataset, 'zip' AS GeographyLevel
FROM (SELECT l_suppkey, CAST(date_trunc('month', l_shipdate) AS DATE) AS Date,
             avg(l_extendedprice / nullif(l_quantity, 0)) / 12.0 AS v
      FROM lineitem GROUP BY 1, 2) a
JOIN supplier s ON a.l_suppkey = s.s_suppkey
JOIN nation n ON s.s_nationkey = n.n_nationkey
JOIN region r ON n.n_regionkey = r.r_regionkey
"""

_NATION_PANEL = """
SELECT CAST(n.n_nationkey AS BIGINT) AS RegionID, CAST(n.n_nationkey AS INTEGER) AS SizeRank,
       n.n_name AS RegionName, 'msa' AS RegionType, r.r_name AS StateName, substr(r.r_name, 1, 2) AS State,
       n.n_name AS Metro, CAST(NULL AS VARCHAR) AS CountyName, a.Date AS Date, CAST(a.v AS DOUBLE) AS Value,
       '{dataset}' AS Dataset, 'metro' AS GeographyLevel
FROM ({inner}) a
JOIN nation n ON a.s_nationkey = n.n_nationkey
JOIN region r ON n.n_regionkey = r.r_regionkey
"""

INVENTORY = _NATION_PANEL.format(dataset="inventory_metro", inner="""
SELECT s.s_nationkey, CAST(date_trunc('month', l.l_shipdate) AS DATE) AS Date, SUM(l.l_quantity) AS v
FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey GROUP BY 1, 2""")

SALES = _NATION_PANEL.format(dataset="sales_count_metro", inner="""
SELECT s.s_nationkey, CAST(date_trunc('month', l.l_shipdate) AS DATE) AS Date, COUNT(DISTINCT l.l_orderkey) AS v
FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey
GROUP BY 1, 2""")

PANEL_SQL = {"home": HOME, "rent": RENT, "inventory": INVENTORY, "sales": SALES}

LONG_COLS = ["RegionID", "SizeRank", "RegionName", "RegionType", "StateName", "State", "Metro", "CountyName",
             "Date", "Value", "Dataset", "GeographyLevel"]


def with_panels(body: str, *names: str) -> str:
    """Prefix a query with CTEs for the named panels."""
    ctes = ",\n".join(f"{n} AS ({PANEL_SQL[n]})" for n in names)
    return f"WITH {ctes}\n{body}"


W = "PARTITION BY RegionName ORDER BY Date"


def frame(n: int) -> str:
    return f"({W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def lag_exprs(v: str = "Value") -> list[tuple[str, str]]:
    return [(f"{v}_lag_{n}", f"lag({v}, {n}) OVER ({W})") for n in TP.lags]


def rolling_exprs(v: str = "Value", kinds=("mean", "std", "min", "max")) -> list[tuple[str, str]]:
    fn = {"mean": "avg", "std": "stddev_samp", "min": "min", "max": "max"}
    out = []
    for n in TP.windows:
        for k in kinds:
            out.append((f"{v}_rolling_{k}_{n}", f"{fn[k]}({v}) OVER {frame(n)}"))
    return out


def change_exprs(v: str = "Value", kinds=("pct_change", "diff")) -> list[tuple[str, str]]:
    out = []
    for n in TP.changes:
        prev = f"lag({v}, {n}) OVER ({W})"
        if "pct_change" in kinds:
            out.append((f"{v}_pct_change_{n}", f"{v} / nullif({prev}, 0) - 1.0"))
        if "diff" in kinds:
            out.append((f"{v}_diff_{n}", f"{v} - {prev}"))
    return out


def trend_exprs(v: str = "Value") -> list[tuple[str, str]]:
    out = []
    for k in TP.trends:
        f = frame(k)
        out.append((f"{v}_trend_{k}",
                    f"CASE WHEN count({v}) OVER {f} >= {TP.trend_min_rows} "
                    f"THEN regr_slope({v}, CAST(_rn AS DOUBLE)) OVER {f} END"))
    return out


def target_exprs(v: str = "Value") -> list[tuple[str, str]]:
    out = []
    for h in HORIZONS:
        fut = f"lead({v}, {h}) OVER ({W})"
        ret = f"({fut} / nullif({v}, 0) - 1.0) * 100.0"
        out += [
            (f"target_value_{h}m", fut),
            (f"target_return_{h}m", ret),
            (f"target_direction_{h}m", f"CAST(coalesce(({ret}) > 0, false) AS INTEGER)"),
            (f"target_category_{h}m",
             f"CAST(CASE WHEN ({ret}) IS NULL THEN NULL WHEN ({ret}) < -5 THEN 0 WHEN ({ret}) < -1 THEN 1 "
             f"WHEN ({ret}) < 1 THEN 2 WHEN ({ret}) < 5 THEN 3 ELSE 4 END AS INTEGER)"),
        ]
    return out


def select_list(pairs: list[tuple[str, str]], doubles: set[str] | None = None, scale: int = 4) -> str:
    """``expr AS name`` list; names in ``doubles`` (or all if None) are rounded."""
    parts = []
    for name, expr in pairs:
        if doubles is None or name in doubles:
            parts.append(f"{rnd(expr, scale)} AS {name}")
        else:
            parts.append(f"{expr} AS {name}")
    return ",\n  ".join(parts)


# --- market panel (JN-1..4, PRJ-5..7) ----------------------------------------------------------------------------

def _state_volume(panel: str, label: str) -> str:
    return (f"SELECT StateName, Date, avg(Value) AS State_{label}_Mean, sum(Value) AS State_{label}_Total "
            f"FROM {panel} WHERE StateName IS NOT NULL AND Date IS NOT NULL GROUP BY StateName, Date")


MARKET_BODY = f"""
m0 AS (
  SELECT h.*, r.Value AS Rent,
         h.Value / nullif(r.Value * 12.0, 0) AS PriceToRentRatio,
         (r.Value * 12.0) / 70000.0 AS RentAffordabilityRatio,
         h.Value - (r.Value * 12.0) * 20.0 AS PriceRentSpread,
         si.State_Inventory_Mean, si.State_Inventory_Total, ss.State_Sales_Mean, ss.State_Sales_Total,
         si.State_Inventory_Total / nullif(ss.State_Sales_Total, 0) AS MonthsOfSupply,
         ss.State_Sales_Total / nullif(si.State_Inventory_Total, 0) AS MarketLiquidity
  FROM home h
  LEFT JOIN rent r ON h.RegionName IS NOT DISTINCT FROM r.RegionName AND h.Date IS NOT DISTINCT FROM r.Date
  LEFT JOIN ({_state_volume('inventory', 'Inventory')}) si ON h.StateName = si.StateName AND h.Date = si.Date
  LEFT JOIN ({_state_volume('sales', 'Sales')}) ss ON h.StateName = ss.StateName AND h.Date = ss.Date
),
nat AS (
  SELECT Date, avg(Value) AS National_mean, median(Value) AS National_median, stddev_samp(Value) AS National_std
  FROM m0 WHERE Date IS NOT NULL GROUP BY Date
),
market AS (
  SELECT m0.*, nat.National_mean, nat.National_median, nat.National_std,
         m0.Value / nullif(nat.National_mean, 0) AS ValueVsNational,
         m0.Value / nullif(nat.National_median, 0) AS ValueVsNationalMedian
  FROM m0 LEFT JOIN nat ON m0.Date = nat.Date
)"""

MARKET_COLS = ["Rent", "PriceToRentRatio", "RentAffordabilityRatio", "PriceRentSpread", "State_Inventory_Mean",
               "State_Inventory_Total", "State_Sales_Mean", "State_Sales_Total", "MonthsOfSupply", "MarketLiquidity",
               "National_mean", "National_median", "National_std", "ValueVsNational", "ValueVsNationalMedian"]


def with_market(body: str) -> str:
    ctes = ",\n".join(f"{n} AS ({PANEL_SQL[n]})" for n in ("home", "rent", "inventory", "sales"))
    return f"WITH {ctes},\n{MARKET_BODY}\n{body}"


# --- geographic (JN-5/6, WIN-9/10) over a CTE named `src` ---------------------------------------------------------

def geo_body(src: str) -> str:
    """CTEs g1 (state/metro stats), geo (ranks) over the rows of ``src``."""
    def stats(key: str, p: str) -> str:
        return (f"SELECT {key}, avg(Value) AS {p}_mean, median(Value) AS {p}_median, stddev_samp(Value) AS {p}_std, "
                f"CAST(count(Value) AS DOUBLE) AS {p}_count FROM {src} WHERE {key} IS NOT NULL GROUP BY {key}")
    return f"""
g1 AS (
  SELECT s.*, st.State_mean, st.State_median, st.State_std, st.State_count,
         mt.Metro_mean, mt.Metro_median, mt.Metro_std, mt.Metro_count
  FROM {src} s
  LEFT JOIN ({stats('StateName', 'State')}) st ON s.StateName = st.StateName
  LEFT JOIN ({stats('Metro', 'Metro')}) mt ON s.Metro = mt.Metro
),
geo AS (
  SELECT g1.*,
    CASE WHEN State_count IS NOT NULL AND Date IS NOT NULL THEN
      rank() OVER (PARTITION BY Date, State_count IS NULL ORDER BY State_count DESC) - 1
      + (count(*) OVER (PARTITION BY Date, State_count) + 1) / 2.0 END AS StateRank,
    CASE WHEN StateName IS NOT NULL AND Value IS NOT NULL THEN
      (rank() OVER (PARTITION BY StateName, Date, Value IS NULL ORDER BY Value) - 1
       + (count(*) OVER (PARTITION BY StateName, Date, Value) + 1) / 2.0)
      / count(Value) OVER (PARTITION BY StateName, Date) END AS ValueRankInState
  FROM g1
)"""


GEO_COLS = ["State_mean", "State_median", "State_std", "State_count", "Metro_mean", "Metro_median", "Metro_std",
            "Metro_count", "StateRank", "ValueRankInState"]


# --- calendar ---------------------------------------------------------------------------

ERA_SQL = ("CASE WHEN Date < DATE '2008-01-01' THEN 'pre_crisis' WHEN Date < DATE '2012-01-01' THEN 'crisis_recovery' "
           "WHEN Date < DATE '2020-01-01' THEN 'post_crisis' WHEN Date < DATE '2022-01-01' THEN 'covid_boom' "
           "ELSE 'post_covid' END")


def months_since_sql(table: str) -> str:
    """PRJ-3 over the dates of a table."""
    return (f"CAST(round(datediff('day', (SELECT min(Date) FROM {table}), Date) / 30.44) AS DOUBLE) AS MonthsSinceStart, "
            f"CAST(round(datediff('day', Date, (SELECT max(Date) FROM {table})) / 30.44) AS DOUBLE) AS MonthsSinceLatest")
