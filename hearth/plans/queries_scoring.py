"""Registered queries: bulk scoring of requests and the persistence forecast
(SURVEY 2.10 ML-6, 2.11 EVL-1, 2.12 SCR-1..14)."""

from __future__ import annotations

from pyspark.sql import functions as F

from hearth.operators import scoring as sc
from hearth.operators import temporal as tm
from hearth.operators.evaluation import metrics
from hearth.operators.history import RunLog, changes, latest_best
from hearth.plans import oracle as O
from hearth.plans.queries_market import feature_table_sql
from hearth.plans.registry import register
from hearth.plans.queries_training import CATEGORICAL, CHECKED, FEATURES, _sql_base, narrow_split_frame
from hearth.session import materialize, scratch_path
from hearth.sources import panels as P

R = O.rnd
AS_OF = "2024-06-15"  # scoring date: a parameter, never now()
_STATES_SQL = "[" + ", ".join(f"'{s}'" for s in sc.US_STATES) + "]"
_ALL_STATES_SQL = "(" + ", ".join(f"'{s}'" for s in sc.US_STATES) + ")"
_SEG = " ".join(f"WHEN '{s}' THEN '{t}'" for s, t in P.SEGMENT_PROPERTY_TYPES)

REQ = f"""req AS (
  SELECT c_custkey AS request_id,
         CASE WHEN c_custkey % 17 = 0 THEN substr(lpad(CAST(c_custkey % 100000 AS VARCHAR), 5, '0'), 2, 4)
              ELSE lpad(CAST(c_custkey % 100000 AS VARCHAR), 5, '0') END AS zip_code,
         CAST(c_custkey % (SELECT max(s_suppkey) FROM supplier) + 1 AS VARCHAR) AS region,
         CASE WHEN c_custkey % 23 = 0 THEN 'ZZ' WHEN c_custkey % 5 = 0 THEN lower(st) ELSE st END AS state,
         CAST(c_acctbal * 250 AS DOUBLE) AS current_value,
         CASE c_mktsegment {_SEG} ELSE '{P.UNKNOWN_PROPERTY_TYPE}' END AS property_type,
         CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_acctbal * 250 / (12 * (5 + c_custkey % 30)) END AS recent_rent
  FROM (SELECT *, {_STATES_SQL}[c_nationkey % 25 + 25 * (c_custkey % 2) + 1] AS st FROM customer) c
),
val AS (
  SELECT request_id, region, zip_code, upper(state) AS state, current_value, property_type, recent_rent,
         concat_ws('; ', CASE WHEN NOT z THEN '{sc.MSG_ZIP}' END, CASE WHEN NOT s THEN '{sc.MSG_STATE}' END,
                   CASE WHEN NOT v THEN '{sc.MSG_VALUE.format(int(sc.MIN_VALUE_V2))}' END,
                   CASE WHEN NOT r THEN '{sc.MSG_RENT}' END) AS errors,
         z AND s AND v AND r AS valid
  FROM (SELECT *, coalesce(regexp_matches(zip_code, '^[0-9]{{5}}$'), false) AS z,
               coalesce(upper(state) IN {_ALL_STATES_SQL}, false) AS s,
               coalesce(current_value > {sc.MIN_VALUE_V2}, false) AS v,
               recent_rent IS NULL OR recent_rent > 0 AS r FROM req) q
)"""

_D1 = repr((1.0 / (1.0 - 0.005) - 1.0) * 100.0)
_D3 = repr((1.0 / (1.0 - 0.015) - 1.0) * 100.0)
_M1, _M3 = repr(sc.INTERVAL_Z * sc.RMSE_1M), repr(sc.INTERVAL_Z * sc.RMSE_3M)

SCORED = f""",
latest AS (
  SELECT RegionName, Value AS rv, l1 AS rl1, l3 AS rl3 FROM (
    SELECT RegionName, Value, lag(Value, 1) OVER (PARTITION BY RegionName ORDER BY Date) AS l1,
           lag(Value, 3) OVER (PARTITION BY RegionName ORDER BY Date) AS l3,
           Date FROM home) h WHERE Date <= DATE '{AS_OF}' QUALIFY row_number() OVER (PARTITION BY RegionName ORDER BY Date DESC) = 1
),
raw AS (
  SELECT val.*,
    coalesce((rv / nullif(rl1, 0) - 1.0) * 100.0, CAST({_D1} AS DOUBLE)) AS raw_1m,
    coalesce((rv / nullif(rl3, 0) - 1.0) * 100.0, CAST({_D3} AS DOUBLE)) AS raw_3m,
    (CASE WHEN current_value > 1000000.0 THEN -0.5 WHEN current_value < 200000.0 THEN -0.3 ELSE 0.0 END)
      + (CASE WHEN state IN ('CA', 'NY', 'FL', 'NV', 'AZ') THEN -0.4 ELSE 0.0 END) AS adj_low,
    (CASE WHEN current_value > 1000000.0 THEN 0.2 WHEN current_value < 200000.0 THEN 0.8 ELSE 0.0 END)
      + (CASE WHEN state IN ('CA', 'NY', 'FL', 'NV', 'AZ') THEN 0.3 ELSE 0.0 END) AS adj_high
  FROM val LEFT JOIN latest ON val.region = latest.RegionName
),
clipped AS (
  SELECT *, (adj_low + adj_high) / 2.0 AS adj_mid,
    least(greatest(raw_1m + (adj_low + adj_high) / 2.0, -8.0), 12.0) AS c1,
    least(greatest(raw_3m + (adj_low + adj_high) / 2.0, -15.0), 25.0) AS c3 FROM raw
),
pts AS (
  SELECT *,
    (CASE WHEN c1 > 5 OR c3 > 10 THEN 2 WHEN c1 > 2 OR c3 > 5 THEN 1 ELSE 0 END)
    + (CASE WHEN c1 < -2 OR c3 < -5 THEN 3 WHEN c1 < 0 OR c3 < 0 THEN 2 ELSE 0 END)
    + (CASE WHEN current_value > 2000000 THEN 1 WHEN current_value < 100000 THEN 2 ELSE 0 END)
    + (CASE WHEN recent_rent IS NOT NULL AND recent_rent <> 0
              AND (current_value / nullif(recent_rent * 12.0, 0) > 30 OR current_value / nullif(recent_rent * 12.0, 0) < 10)
            THEN 1 ELSE 0 END) AS p
  FROM clipped
),
scored AS (
  SELECT request_id, zip_code, state, current_value, property_type, recent_rent, errors, valid,
    raw_1m, raw_3m, adj_low, adj_high, adj_mid, valid AS success,
    CASE WHEN NOT valid THEN errors END AS error,
    CASE WHEN valid THEN {R('c1', 2)} END AS return_1m, CASE WHEN valid THEN {R('c3', 2)} END AS return_3m,
    CASE WHEN valid THEN p END AS risk_points,
    CASE WHEN valid THEN (CASE WHEN p >= 4 THEN 'High' WHEN p >= 2 THEN 'Medium' ELSE 'Low' END) END AS risk_category,
    CASE WHEN valid THEN (CASE WHEN raw_1m < -2 OR raw_3m < -5 THEN 'High' WHEN raw_1m > 2 AND raw_3m > 5 THEN 'Low'
         ELSE 'Medium' END) END AS risk_simple,
    'pred_' || CAST(request_id AS VARCHAR) AS prediction_id, '1m:persistence, 3m:persistence' AS model_version,
    DATE '{AS_OF}' AS prediction_date,
    CASE WHEN valid THEN raw_1m - {_M1} END AS return_1m_lower, CASE WHEN valid THEN raw_1m + {_M1} END AS return_1m_upper,
    CASE WHEN valid THEN raw_3m - {_M3} END AS return_3m_lower, CASE WHEN valid THEN raw_3m + {_M3} END AS return_3m_upper
  FROM pts
)"""


def _req_sql(body: str, scored: bool = False) -> str:
    if scored:
        return O.with_panels(f",\n{REQ}{SCORED}\n{body}", "home")
    return f"WITH {REQ}\n{body}"


def _validated(spark, sf):
    return sc.validate_requests(P.requests(spark, sf))


def _latest(spark, sf):
    home = P.home_panel(spark, sf)
    w = tm.region_window()
    lagged = home.withColumns({"Value_lag_1": F.lag("Value", 1).over(w), "Value_lag_3": F.lag("Value", 3).over(w)})
    # written once: the scoring join, and every micro-batch of the stream, read it
    return materialize(sc.latest_region_rows(lagged, as_of=AS_OF).select("RegionName", "Value", "Value_lag_1", "Value_lag_3"), "latest")


def _scored(spark, sf):
    return sc.score(P.requests(spark, sf), _latest(spark, sf), AS_OF)


def _rsel(cols, doubles=()):
    return ", ".join(f"{R(c)} AS {c}" if c in doubles else c for c in cols)


_REQ_COLS = ["request_id", "zip_code", "state", "current_value", "property_type", "recent_rent"]


@register("validate_requests", _req_sql(
    f"SELECT {_rsel(_REQ_COLS, ('current_value', 'recent_rent'))}, errors, valid FROM val"))
def validate_requests(spark, sf):
    return _validated(spark, sf).select(*_REQ_COLS, "errors", "valid")




_DATE_SQL = (("Year", "year(d)"), ("Month", "month(d)"), ("Quarter", "quarter(d)"), ("DayOfYear", "dayofyear(d)"),
             ("WeekOfYear", "weekofyear(d)"), ("Month_sin", "sin(2 * pi() * month(d) / 12.0)"),
             ("Month_cos", "cos(2 * pi() * month(d) / 12.0)"), ("Quarter_sin", "sin(2 * pi() * quarter(d) / 4.0)"),
             ("Quarter_cos", "cos(2 * pi() * quarter(d) / 4.0)"), ("MonthsSinceStart", "(year(d) - 2000) * 12 + month(d)"),
             ("MonthsSinceLatest", "0.0"),
             ("MarketEra", "CASE WHEN year(d) >= 2022 THEN 4.0 WHEN year(d) >= 2020 THEN 3.0 ELSE 2.0 END"))


@register("request_date_features", _req_sql(
    "SELECT request_id, " + ", ".join(f"{R(e)} AS {n}" for n, e in _DATE_SQL)
    + f" FROM (SELECT *, DATE '{AS_OF}' AS d FROM val WHERE valid) v"))
def request_date_features(spark, sf):
    v = _validated(spark, sf).where("valid")
    return v.select("request_id", *[e.alias(n) for n, e in sc.date_features(AS_OF).items()])


_RENT_SQL = (("Rent", "CASE WHEN g THEN recent_rent ELSE current_value / 12.0 / 25.0 END"),
             ("PriceToRentRatio", "CASE WHEN g THEN current_value / nullif(recent_rent * 12.0, 0) ELSE 25.0 END"),
             ("RentAffordabilityRatio",
              "(CASE WHEN g THEN recent_rent ELSE current_value / 12.0 / 25.0 END) * 12.0 / 70000.0"),
             ("PriceRentSpread", "CASE WHEN g THEN current_value - recent_rent * 12.0 * 20.0 ELSE 0.0 END"))


@register("request_rent_features", _req_sql(
    "SELECT request_id, " + ", ".join(f"{R(e)} AS {n}" for n, e in _RENT_SQL)
    + " FROM (SELECT *, recent_rent IS NOT NULL AND recent_rent > 0 AS g FROM val WHERE valid) v"))
def request_rent_features(spark, sf):
    v = _validated(spark, sf).where("valid")
    return v.select("request_id", *[e.alias(n) for n, e in sc.rent_features().items()])


def _value_sql() -> list[tuple[str, str]]:
    v = "current_value"
    st = "CAST(list_position([" + ", ".join(f"'{s}'" for s in sc.US_STATES) + "], state) - 1 AS DOUBLE)"
    zi = "TRY_CAST(zip_code AS INTEGER)"
    out = [("SizeRank", f"CAST({zi} % 1000 AS DOUBLE)"),
           ("RegionType", "CASE property_type " + " ".join(f"WHEN '{k}' THEN {float(c)}"
                                                            for k, c in sc.PROPERTY_TYPE_CODES.items()) + " ELSE 0.0 END"),
           ("StateName", st), ("State", st),
           ("Metro", "CAST(TRY_CAST(substr(zip_code, 1, 3) AS INTEGER) % 100 AS DOUBLE)"),
           ("CountyName", "CAST(TRY_CAST(substr(zip_code, 1, 2) AS INTEGER) % 200 AS DOUBLE)"),
           ("National_mean", "400000.0"), ("National_median", "350000.0"), ("National_std", "200000.0"),
           ("ValueVsNational", f"{v} / 400000.0"), ("ValueVsNationalMedian", f"{v} / 350000.0"),
           ("State_mean", f"{v} * 1.0"), ("State_median", f"{v} * 0.9"), ("State_std", f"{v} * 0.3"),
           ("State_count", "1000.0"), ("GeographicCluster", f"CAST({zi} % 10 AS DOUBLE)"),
           ("StateRank", f"{st} % 20.0"), ("ValueRankInState", "0.5"),
           ("State_Inventory_Mean", "5000.0"), ("State_Inventory_Total", "50000.0"), ("State_Sales_Mean", "1000.0"),
           ("State_Sales_Total", "10000.0"), ("MonthsOfSupply", "5.0"), ("MarketLiquidity", "0.2"),
           ("Value_momentum_short", "1.02"), ("Value_momentum_long", "1.05"), ("Value_volatility_3m", "0.05"),
           ("Value_volatility_12m", "0.1")]
    for n in (1, 3, 6, 12, 24):
        out.append((f"Value_lag_{n}", f"{v} * CAST({repr(1.0 - n * 0.005)} AS DOUBLE)"))
    for n in (3, 6, 12, 24):
        out += [(f"Value_rolling_mean_{n}", f"{v} * 1.0"), (f"Value_rolling_std_{n}", f"{v} * 0.1"),
                (f"Value_rolling_min_{n}", f"{v} * 0.9"), (f"Value_rolling_max_{n}", f"{v} * 1.1")]
    for p in (3, 6, 12, 24, 36):
        g = repr(sc.ANNUAL_GROWTH / 12.0 * p)
        out += [(f"Value_pct_change_{p}", f"CAST({g} AS DOUBLE)"), (f"Value_diff_{p}", f"{v} * CAST({g} AS DOUBLE)")]
    for k in (6, 12, 24):
        out.append((f"Value_trend_{k}", f"{v} * 0.001"))
    return out


@register("request_value_features", _req_sql(
    "SELECT request_id, " + ", ".join(f"{R(e)} AS {n}" for n, e in _value_sql()) + " FROM val WHERE valid"))
def request_value_features(spark, sf):
    v = _validated(spark, sf).where("valid")
    return v.select("request_id", *[e.cast("double").alias(n) for n, e in sc.value_features().items()])


_METRO_SQL = (("Metro_mean", "current_value * 1.0"), ("Metro_median", "current_value * 1.0"), ("Metro_std", "current_value * 0.2"),
              ("Metro_count", "500.0"))


def _vector_sql() -> dict[str, str]:
    rules = dict(_DATE_SQL) | dict(_RENT_SQL) | dict(_value_sql()) | dict(_METRO_SQL)
    return {c: f"CAST({rules.get(c, '0.0')} AS DOUBLE)" for c in FEATURES}


_VALID_SQL = (f"(SELECT *, DATE '{AS_OF}' AS d, recent_rent IS NOT NULL AND recent_rent > 0 AS g FROM val WHERE valid) v")


@register("request_vector", _req_sql("SELECT request_id, " + ", ".join(f"{R(e)} AS {c}" for c, e in _vector_sql().items())
                                     + f" FROM {_VALID_SQL}"))
def request_vector(spark, sf):
    """SCR-5: the 82-feature vector in training order, defaults by name pattern."""
    v = _validated(spark, sf).where("valid")
    return sc.request_vector(v, FEATURES, AS_OF).select("request_id", *FEATURES)


#: Numeric features that the region's latest row gives; the request itself gives the date and the rent.
_ACTUAL = [c for c in CHECKED if c not in CATEGORICAL and c not in dict(_DATE_SQL) and c not in dict(_RENT_SQL)]


@register("request_actual_features", "WITH ft AS (" + feature_table_sql(rounded=False) + f"),\n{REQ},\n"
          f"latest AS (SELECT * FROM ft WHERE Date <= DATE '{AS_OF}' QUALIFY row_number() OVER (PARTITION BY RegionName ORDER BY Date DESC) = 1)\n"
          "SELECT request_id, region AS matched_region, l.RegionName IS NOT NULL AS matched, " + ", ".join(
              (R(f"coalesce(CAST(l.{c} AS DOUBLE), {e})") if c in _ACTUAL else R(e)) + f" AS {c}"
              for c, e in _vector_sql().items())
          + f" FROM {_VALID_SQL} LEFT JOIN (SELECT RegionName, {', '.join(_ACTUAL)} FROM latest) l ON v.region = l.RegionName")
def request_actual_features(spark, sf):
    """SCR-6: the matched region's whole latest feature row, as of the scoring day, overrides the defaults."""
    from hearth.plans.features import latest_features, market_panel
    latest = latest_features(market_panel(spark, sf), AS_OF)
    lk = latest.select(F.col("RegionName").alias("_region"), *[F.col(c).alias(f"_a_{c}") for c in _ACTUAL])
    lk = materialize(lk, "latest-features")  # a row per region: its size is known to the join
    v = _validated(spark, sf).where("valid").withColumn("_region", sc.region_key())
    v = v.join(lk.withColumn("_found", F.lit(True)), "_region", "left")
    known = sc.value_features()
    actual = {c: F.coalesce(F.col(f"_a_{c}").cast("double"), known[c] if c in known else sc.default_for(c)) for c in _ACTUAL}
    out = sc.request_vector(v, FEATURES, AS_OF, actual)
    return out.select("request_id", F.col("_region").alias("matched_region"), F.col("_found").isNotNull().alias("matched"), *FEATURES)


_AS_OF_VALUES = ("Value", "Value_lag_1", "Value_lag_3", "Value_lag_12")


@register("request_as_of_features", O.with_panels(
    ",\nlagged AS (SELECT RegionName, Date, Value, " + ", ".join(f"lag(Value, {n}) OVER ({O.W}) AS Value_lag_{n}" for n in (1, 3, 12)) + " FROM home),\n"
    "req AS (SELECT o_orderkey AS request_id, CAST(o_custkey % (SELECT max(s_suppkey) FROM supplier) + 1 AS VARCHAR) AS region, "
    "CAST(o_orderdate AS DATE) AS as_of FROM orders)\n"
    "SELECT request_id, region, as_of, CAST(l.Date AS DATE) AS matched_date, " + ", ".join(f"{R('l.' + c)} AS {c}" for c in _AS_OF_VALUES)
    + " FROM req ASOF LEFT JOIN lagged l ON req.region = l.RegionName AND req.as_of >= l.Date", "home"))
def request_as_of_features(spark, sf):
    """SCR-6, as of each request's own day: the region's last row of that day or earlier."""
    home = P.home_panel(spark, sf)
    w = tm.region_window()
    lagged = materialize(home.select("RegionName", "Date", "Value", *[F.lag("Value", n).over(w).alias(f"Value_lag_{n}") for n in (1, 3, 12)]), "lagged")
    out = sc.region_rows_as_of(P.dated_requests(spark, sf), lagged, _AS_OF_VALUES)
    return out.select("request_id", "region", "as_of", "matched_date", *_AS_OF_VALUES)


DRAW_SEED = 42


@register("adjustment_draws", _req_sql("SELECT request_id, true AS within_bounds, adj_low = adj_high AS fixed FROM scored", scored=True))
def adjustment_draws(spark, sf):
    """SCR-7 with reproducible draws: SQL tells that each lies within its bounds; tests hold the numbers."""
    s = sc.score(P.requests(spark, sf), _latest(spark, sf), AS_OF, draw_seed=DRAW_SEED)
    return s.select("request_id", F.col("adjustment").between(F.col("adj_low"), F.col("adj_high")).alias("within_bounds"),
                    (F.col("adj_low") == F.col("adj_high")).alias("fixed"))


_SCORE_COLS = ["request_id", "zip_code", "state", "current_value", "success", "error", "return_1m", "return_3m",
               "risk_points", "risk_category", "risk_simple", "prediction_id", "model_version", "prediction_date",
               "return_1m_lower", "return_1m_upper", "return_3m_lower", "return_3m_upper"]
_SCORE_DOUBLES = ("current_value", "return_1m", "return_3m", "return_1m_lower", "return_1m_upper",
                  "return_3m_lower", "return_3m_upper")


@register("batch_score", _req_sql(f"SELECT {_rsel(_SCORE_COLS, _SCORE_DOUBLES)} FROM scored", scored=True))
def batch_score(spark, sf):
    return _scored(spark, sf).select(*_SCORE_COLS)


@register("market_adjustment", _req_sql(
    f"SELECT request_id, state, {R('current_value')} AS current_value, {R('adj_low')} AS adj_low, "
    f"{R('adj_high')} AS adj_high, {R('adj_mid')} AS adj_mid FROM clipped", scored=True))
def market_adjustment(spark, sf):
    return _scored(spark, sf).select("request_id", "state", "current_value", "adj_low", "adj_high", "adj_mid")


@register("clip_predictions", _req_sql(
    f"SELECT request_id, {R('raw_1m')} AS raw_1m, {R('raw_3m')} AS raw_3m, return_1m, return_3m FROM scored "
    "WHERE success", scored=True))
def clip_predictions(spark, sf):
    return _scored(spark, sf).where("success").select("request_id", "raw_1m", "raw_3m", "return_1m", "return_3m")


@register("prediction_intervals", _req_sql(
    "SELECT request_id, " + ", ".join(f"{R(c)} AS {c}" for c in (
        "return_1m_lower", "return_1m_upper", "return_3m_lower", "return_3m_upper")) + " FROM scored WHERE success",
    scored=True))
def prediction_intervals(spark, sf):
    return _scored(spark, sf).where("success").select("request_id", "return_1m_lower", "return_1m_upper",
                                                      "return_3m_lower", "return_3m_upper")


@register("risk_simple", _req_sql(
    f"SELECT request_id, {R('raw_1m')} AS raw_1m, {R('raw_3m')} AS raw_3m, risk_simple FROM scored WHERE success",
    scored=True))
def risk_simple(spark, sf):
    return _scored(spark, sf).where("success").select("request_id", "raw_1m", "raw_3m", "risk_simple")


@register("risk_score", _req_sql(
    "SELECT request_id, risk_points, risk_category FROM scored WHERE success", scored=True))
def risk_score(spark, sf):
    return _scored(spark, sf).where("success").select("request_id", "risk_points", "risk_category")


@register("batch_summary", _req_sql(
    "SELECT count(*) AS total, count(*) FILTER (WHERE success) AS successful, "
    "count(*) FILTER (WHERE NOT success) AS failed FROM scored", scored=True))
def batch_summary(spark, sf):
    return sc.batch_summary(_scored(spark, sf))


@register("state_market_summary", _req_sql(
    f"SELECT state, count(*) AS requests, {R('avg(return_1m)')} AS avg_return_1m, {R('avg(return_3m)')} AS avg_return_3m, "
    "count(*) FILTER (WHERE risk_category = 'High') AS high_risk, "
    "count(*) FILTER (WHERE risk_category = 'Medium') AS medium_risk, "
    "count(*) FILTER (WHERE risk_category = 'Low') AS low_risk FROM scored WHERE success GROUP BY state", scored=True))
def state_market_summary(spark, sf):
    return sc.state_market_summary(_scored(spark, sf))


# --- ML-6, EVL-1 ----------------------------------------------------------------------------------------------

_H = (1, 3, 6, 12)


@register("persistence_forecast", O.with_panels(
    "SELECT RegionName, Date, " + R("Value") + " AS Value, " + ", ".join(
        f"{R(f'(Value / nullif(lag(Value, {h}) OVER ({O.W}), 0) - 1.0) * 100.0')} AS forecast_{h}m" for h in _H)
    + " FROM home", "home"))
def persistence_forecast(spark, sf):
    home = P.home_panel(spark, sf)
    w = tm.region_window()
    return home.select("RegionName", "Date", "Value", *[
        sc.persistence(F.col("Value"), F.lag("Value", h).over(w)).alias(f"forecast_{h}m") for h in _H])


def eval_frame(spark, sf):
    """Test-split rows as (target, model, y, pred) for the persistence forecasts."""
    return eval_rows(narrow_split_frame(spark, sf).where(F.col("split") == "test"))


def eval_rows(df):
    """(target, model, y, pred) of the persistence forecasts for rows with lags and targets."""
    parts = None
    for h in _H:
        p = df.select(F.lit(f"target_return_{h}m").alias("target"), F.lit("persistence").alias("model"),
                      F.col(f"target_return_{h}m").alias("y"),
                      sc.persistence(F.col("Value"), F.col(f"Value_lag_{h}")).alias("pred"))
        parts = p if parts is None else parts.unionByName(p)
    return parts


@register("eval_metrics", _sql_base(
    ",\nev AS (" + " UNION ALL ".join(
        f"SELECT 'target_return_{h}m' AS target, 'persistence' AS model, target_return_{h}m AS y, "
        f"(Value / nullif(Value_lag_{h}, 0) - 1.0) * 100.0 AS pred FROM sp2 WHERE split = 'test'" for h in _H)
    + "),\nev2 AS (SELECT * FROM ev WHERE y IS NOT NULL AND pred IS NOT NULL),\n"
    "mm AS (SELECT target, model, avg(y) AS ybar FROM ev2 GROUP BY target, model)\n"
    f"SELECT ev2.target, ev2.model, count(*) AS n, {R('sqrt(avg((y - pred) * (y - pred)))')} AS rmse, "
    f"{R('avg(abs(y - pred))')} AS mae, "
    f"{R('1.0 - sum((y - pred) * (y - pred)) / nullif(sum((y - ybar) * (y - ybar)), 0)')} AS r2 "
    "FROM ev2 JOIN mm ON ev2.target = mm.target AND ev2.model = mm.model GROUP BY ev2.target, ev2.model"))
def eval_metrics(spark, sf):
    return metrics(eval_frame(spark, sf))


# --- EVL-3, SRC-10: run history -----------------------------------------------------------------------------------

_RUNS = (("run-val", "2024-01-01 10:00:00", "val"), ("run-test", "2024-01-02 10:00:00", "test"))


def _history_sql(body: str) -> str:
    ev = " UNION ALL ".join(
        f"SELECT 'target_return_{h}m' AS target, 'persistence' AS model, split, target_return_{h}m AS y, "
        f"(Value / nullif(Value_lag_{h}, 0) - 1.0) * 100.0 AS pred FROM sp2" for h in _H)
    runs = " UNION ALL ".join(f"SELECT '{run}' AS run, TIMESTAMP '{at}' AS ended, '{split}' AS split" for run, at, split in _RUNS)
    return _sql_base(f",\nev AS ({ev}), ev2 AS (SELECT * FROM ev WHERE y IS NOT NULL AND pred IS NOT NULL), runs AS ({runs}),\n"
                     "mm AS (SELECT target, split, avg(y) AS ybar FROM ev2 GROUP BY target, split),\n"
                     "log AS (SELECT run, ended, ev2.target, ev2.model, count(*) AS n, sqrt(avg((y - pred) * (y - pred))) AS rmse, avg(abs(y - pred)) AS mae, "
                     "1.0 - sum((y - pred) * (y - pred)) / nullif(sum((y - ybar) * (y - ybar)), 0) AS r2 "
                     "FROM ev2 JOIN mm ON ev2.target = mm.target AND ev2.split = mm.split JOIN runs ON runs.split = ev2.split GROUP BY ALL)\n" + body)


def _run_log(spark, sf):
    """The log after two evaluations, the second committed twice (a replay)."""
    log = RunLog(spark, scratch_path(spark, "runs"))
    rows = narrow_split_frame(spark, sf)
    for run, at, split in (*_RUNS, _RUNS[-1]):
        log.commit(run, at, metrics(eval_rows(rows.where(F.col("split") == split))))
    return log.rows()


_LOG_SQL = f"{R('rmse')} AS rmse, {R('mae')} AS mae, {R('r2')} AS r2"


@register("run_history", _history_sql(f"SELECT run, strftime(ended, '%Y-%m-%d %H:%M:%S') AS ended, target, model, n, {_LOG_SQL} FROM log"))
def run_history(spark, sf):
    """EVL-3: every run's rows."""
    return _run_log(spark, sf).withColumn("ended", F.date_format("ended", "yyyy-MM-dd HH:mm:ss")).drop("params")


@register("run_latest_best", _history_sql(
    f"SELECT run, target, model, n, {_LOG_SQL} FROM log QUALIFY row_number() OVER (PARTITION BY target ORDER BY ended DESC, run DESC, rmse, model) = 1"))
def run_latest_best(spark, sf):
    """SRC-10: the model that a service would load for each target."""
    return latest_best(_run_log(spark, sf)).select("run", "target", "model", "n", "rmse", "mae", "r2")


_BY_RUN = "OVER (PARTITION BY target, model ORDER BY ended, run)"


@register("run_changes", _history_sql(f"SELECT target, model, run, {R('rmse')} AS rmse, {R(f'lag(rmse) {_BY_RUN}')} AS rmse_before, {R(f'min(rmse) {_BY_RUN}')} AS best_so_far FROM log"))
def run_changes(spark, sf):
    """EVL-3: each model run by run."""
    return changes(_run_log(spark, sf)).drop("ended")
