"""Bulk scoring of valuation requests (SCR-1..14): the reference's per-request
HTTP handlers re-aimed as one batch (or streaming) job over a request table.

All rules are column expressions; nothing runs per row in Python. The
reference's random draws (market adjustment, state statistics) are replaced by
their deterministic bounds and midpoints (or, for the adjustment, by draws that depend on the
request and a seed alone), and its salted ``hash()`` encodings
by stable ones (state index, ZIP digits).
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearth.functions.exprs import MEDIAN_INCOME, RENT_MULTIPLE, round_half_up, safe_div
from hearth.operators.asof import as_of_join

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's.
US_STATES = (
    "AL", "AK", "AZ", "AR", "CA", "CO", "CT", "DE", "FL", "GA",
    "HI", "ID", "IL", "IN", "IA", "KS", "KY", "LA", "ME", "MD",
    "MA", "MI", "MN", "MS", "MO", "MT", "NE", "NV", "NH", "NJ",
    "NM", "NY", "NC", "ND", "OH", "OK", "OR", "PA", "RI", "SC",
    "SD", "TN", "TX", "UT", "VT", "VA", "WA", "WV", "WI", "WY",
)
PROPERTY_TYPE_CODES = {"SingleFamily": 0, "Condo": 1, "Townhouse": 2, "MultiFamily": 3}
VOLATILE_STATES = ("CA", "NY", "FL", "NV", "AZ")
MIN_VALUE_V1, MIN_VALUE_V2 = 0.0, 10000.0
MSG_ZIP = "ZIP code must be 5 digits"
MSG_STATE = "Invalid state abbreviation"
MSG_VALUE = "current_value must be greater than {}"
MSG_RENT = "recent_rent must be greater than 0"
NATIONAL_MEAN, NATIONAL_MEDIAN, NATIONAL_STD = 400000.0, 350000.0, 200000.0
TYPICAL_PRICE_TO_RENT = 25.0
CLIP_1M, CLIP_3M = (-8.0, 12.0), (-15.0, 25.0)
RMSE_1M, RMSE_3M = 0.61, 2.47
INTERVAL_Z = 1.5
HIGH_VALUE, LOW_VALUE = 1_000_000.0, 200_000.0
HIGH_VALUE_ADJ, LOW_VALUE_ADJ, VOLATILE_ADJ = (-0.5, 0.2), (-0.3, 0.8), (-0.4, 0.3)
ANNUAL_GROWTH = 0.05
LAG_DISCOUNT = 0.005
MIDPOINTS = {"State_count": 1000.0, "ValueRankInState": 0.5, "State_Inventory_Mean": 5000.0, "State_Inventory_Total": 50000.0,
             "State_Sales_Mean": 1000.0, "State_Sales_Total": 10000.0, "MonthsOfSupply": 5.0, "MarketLiquidity": 0.2,
             "Value_momentum_short": 1.02, "Value_momentum_long": 1.05, "Value_volatility_3m": 0.05, "Value_volatility_12m": 0.1}
STATE_SHARES = {"State_mean": 1.0, "State_median": 0.9, "State_std": 0.3}
# Defaults of training features that no rule names, by the begin of the name: a share of the
# value, a constant, a share or a constant by the months that end the name.
VALUE_SHARES = {"Value_rolling_mean_": 1.0, "Value_rolling_std_": 0.1, "Value_rolling_min_": 0.9, "Value_rolling_max_": 1.1,
                "Value_trend_": 0.001, "Metro_mean": 1.0, "Metro_median": 1.0, "Metro_std": 0.2}
CONSTANTS = {"Value_momentum_": 1.02, "Value_volatility_": 0.05, "Metro_count": 500.0}
LAG_MONTHS, CHANGE_MONTHS = 1, 3  # where a name does not end in months
RISK_GAIN, RISK_LOSS = ((5, 10), (2, 5)), ((-2, -5), (0, 0))
RISK_VALUES, RISK_RATIOS = (2_000_000, 100_000), (30, 10)
# ---------------------------------------------------------------------------


def validate_requests(req: DataFrame, min_value: float = MIN_VALUE_V2) -> DataFrame:
    """SCR-1: 5-digit ZIP, known state (upper-cased), value above the threshold,
    rent absent or positive. Adds ``errors`` (messages joined by '; ', '' when
    valid), ``valid``; ``state`` is upper-cased."""
    zip_ok = F.coalesce(F.col("zip_code").rlike("^[0-9]{5}$"), F.lit(False))
    st = F.upper(F.col("state"))
    state_ok = F.coalesce(st.isin(*US_STATES), F.lit(False))
    value_ok = F.coalesce(F.col("current_value") > F.lit(min_value), F.lit(False))
    rent_ok = F.col("recent_rent").isNull() | (F.col("recent_rent") > 0)
    errors = F.concat_ws("; ", F.when(~zip_ok, F.lit(MSG_ZIP)), F.when(~state_ok, F.lit(MSG_STATE)),
                         F.when(~value_ok, F.lit(MSG_VALUE.format(int(min_value)))),
                         F.when(~rent_ok, F.lit(MSG_RENT)))
    return req.withColumns({"state": st, "errors": errors, "valid": zip_ok & state_ok & value_ok & rent_ok})


def date_features(as_of: str) -> dict[str, Column]:
    """SCR-2 at a fixed scoring date (never ``now()``)."""
    d = F.lit(as_of).cast("date")
    y, m = F.year(d), F.month(d)
    q = F.quarter(d)
    two_pi = 2.0 * math.pi
    return {
        "Year": y.cast("double"), "Month": m.cast("double"), "Quarter": q.cast("double"),
        "DayOfYear": F.dayofyear(d).cast("double"), "WeekOfYear": F.weekofyear(d).cast("double"),
        "Month_sin": F.sin(F.lit(two_pi) * m.cast("double") / F.lit(12.0)),
        "Month_cos": F.cos(F.lit(two_pi) * m.cast("double") / F.lit(12.0)),
        "Quarter_sin": F.sin(F.lit(two_pi) * q.cast("double") / F.lit(4.0)),
        "Quarter_cos": F.cos(F.lit(two_pi) * q.cast("double") / F.lit(4.0)),
        "MonthsSinceStart": ((y - F.lit(2000)) * F.lit(12) + m).cast("double"),
        "MonthsSinceLatest": F.lit(0.0),
        "MarketEra": F.when(y >= 2022, F.lit(4.0)).when(y >= 2020, F.lit(3.0)).otherwise(F.lit(2.0)),
    }


def rent_features() -> dict[str, Column]:
    """SCR-3: from the given rent, or the 25x rule when it is absent."""
    v, r = F.col("current_value"), F.col("recent_rent")
    given = r.isNotNull() & (r > 0)
    typical = v / F.lit(12.0) / F.lit(TYPICAL_PRICE_TO_RENT)
    rent = F.when(given, r).otherwise(typical)
    return {
        "Rent": rent,
        "PriceToRentRatio": F.when(given, safe_div(v, r * F.lit(12.0))).otherwise(F.lit(TYPICAL_PRICE_TO_RENT)),
        "RentAffordabilityRatio": rent * F.lit(12.0) / F.lit(MEDIAN_INCOME),
        "PriceRentSpread": F.when(given, v - r * F.lit(12.0) * F.lit(RENT_MULTIPLE)).otherwise(F.lit(0.0)),
    }


def value_features() -> dict[str, Column]:
    """SCR-4: market defaults derived from the value (deterministic midpoints)."""
    v = F.col("current_value")
    zip_int = F.col("zip_code").try_cast("int")
    state_idx = (F.array_position(F.array(*[F.lit(s) for s in US_STATES]), F.col("state")) - 1).cast("double")
    out = {
        "SizeRank": (zip_int % 1000).cast("double"),
        "RegionType": F.coalesce(*[F.when(F.col("property_type") == k, F.lit(float(c)))
                                   for k, c in PROPERTY_TYPE_CODES.items()], F.lit(0.0)),
        "StateName": state_idx, "State": state_idx,
        "Metro": (F.substring("zip_code", 1, 3).try_cast("int") % 100).cast("double"),
        "CountyName": (F.substring("zip_code", 1, 2).try_cast("int") % 200).cast("double"),
        "National_mean": F.lit(NATIONAL_MEAN), "National_median": F.lit(NATIONAL_MEDIAN),
        "National_std": F.lit(NATIONAL_STD),
        "ValueVsNational": v / F.lit(NATIONAL_MEAN), "ValueVsNationalMedian": v / F.lit(NATIONAL_MEDIAN),
        "GeographicCluster": (zip_int % 10).cast("double"), "StateRank": state_idx % F.lit(20.0),
        **{n: v * F.lit(share) for n, share in STATE_SHARES.items()}, **{n: F.lit(c) for n, c in MIDPOINTS.items()},
    }
    names = [f"Value_lag_{n}" for n in (1, 3, 6, 12, 24)] + [f"Value_trend_{n}" for n in (6, 12, 24)]
    names += [f"Value_rolling_{s}_{n}" for n in (3, 6, 12, 24) for s in ("mean", "std", "min", "max")]
    names += [f"Value_{s}_{n}" for n in (3, 6, 12, 24, 36) for s in ("pct_change", "diff")]
    return out | {n: default_for(n) for n in names}


def default_for(name: str) -> Column:
    """SCR-5 fallback for a training feature the request rules do not produce, by the
    pattern of its name; 0 where no pattern fits."""
    v = F.col("current_value")
    tail = name.rsplit("_", 1)[-1]
    months = int(tail) if tail.isdigit() else None
    if name.startswith("Value_lag_"):
        return v * F.lit(1.0 - (LAG_MONTHS if months is None else months) * LAG_DISCOUNT)
    if name.startswith(("Value_pct_change_", "Value_diff_")):
        grown = ANNUAL_GROWTH / 12.0 * (CHANGE_MONTHS if months is None else months)
        return F.lit(grown) if name.startswith("Value_pct") else v * F.lit(grown)
    for begin, share in VALUE_SHARES.items():
        if name.startswith(begin):
            return v * F.lit(share)
    return F.lit(next((c for begin, c in CONSTANTS.items() if name.startswith(begin)), 0.0))


def request_vector(req: DataFrame, feature_names: Sequence[str], as_of: str,
                   actual: dict[str, Column] | None = None) -> DataFrame:
    """SCR-2..5: one double column per training feature, in training order."""
    known = {**date_features(as_of), **rent_features(), **value_features(), **(actual or {})}
    cols = {n: (known[n] if n in known else default_for(n)).cast("double") for n in feature_names}
    return req.withColumns(cols)


def latest_region_rows(features: DataFrame, region: str = "RegionName", date: str = "Date", as_of: str | None = None) -> DataFrame:
    """SCR-6: each region's latest feature row, of the day ``as_of`` or earlier if that is
    given (window over one region's months)."""
    from pyspark.sql import Window
    w = Window.partitionBy(region).orderBy(F.col(date).desc())
    known = features if as_of is None else features.where(F.col(date) <= F.lit(as_of).cast("date"))
    return known.withColumn("_k", F.row_number().over(w)).where(F.col("_k") == 1).drop("_k")


def region_rows_as_of(req: DataFrame, features: DataFrame, values: Sequence[str], as_of: str = "as_of", region: str = "RegionName",
                      date: str = "Date") -> DataFrame:
    """SCR-6 for requests that each have a day of their own: the region's last feature row of that day or
    earlier (``values``, and its day as matched_date); no later row is looked at."""
    return as_of_join(req, features, "region", as_of, region, date, values, at="matched_date")


def region_key() -> Column:
    """Request -> region: the region it names, else the ZIP's integer value."""
    return F.coalesce(F.col("region"), F.col("zip_code").try_cast("int").cast("string"))


def persistence(v: Column, lag: Column) -> Column:
    """ML-6 (ours): last-period return as the forecast, in percent."""
    return (safe_div(v, lag) - F.lit(1.0)) * F.lit(100.0)


def market_adjustment() -> dict[str, Column]:
    """SCR-7: bounds and midpoint of the reference's random adjustment."""
    v = F.col("current_value")
    band_lo = F.when(v > HIGH_VALUE, F.lit(HIGH_VALUE_ADJ[0])).when(v < LOW_VALUE, F.lit(LOW_VALUE_ADJ[0])) \
        .otherwise(F.lit(0.0))
    band_hi = F.when(v > HIGH_VALUE, F.lit(HIGH_VALUE_ADJ[1])).when(v < LOW_VALUE, F.lit(LOW_VALUE_ADJ[1])) \
        .otherwise(F.lit(0.0))
    vol = F.col("state").isin(*VOLATILE_STATES)
    lo = band_lo + F.when(vol, F.lit(VOLATILE_ADJ[0])).otherwise(F.lit(0.0))
    hi = band_hi + F.when(vol, F.lit(VOLATILE_ADJ[1])).otherwise(F.lit(0.0))
    return {"adj_low": lo, "adj_high": hi, "adj_mid": (lo + hi) / F.lit(2.0)}


def uniform(key: Column, seed: int, stream: int) -> Column:
    """A number in [0, 1) that depends on key, seed and stream alone: 53 bits of their XXH64,
    so a row draws the same at any partitioning, order and rerun."""
    bits = F.shiftrightunsigned(F.xxhash64(key.cast("long"), F.lit(seed).cast("long"), F.lit(stream).cast("long")), 11)
    return bits.cast("double") / F.lit(float(1 << 53))


def adjustment_draw(seed: int, key: str = "request_id") -> Column:
    """SCR-7 as the reference draws it, but reproducibly: one uniform number for the value's band, one
    of its own for a volatile state."""
    v, first, second = F.col("current_value"), uniform(F.col(key), seed, 1), uniform(F.col(key), seed, 2)

    def between(bounds: tuple[float, float], u: Column) -> Column:
        return F.lit(bounds[0]) + F.lit(bounds[1] - bounds[0]) * u

    band = F.when(v > HIGH_VALUE, between(HIGH_VALUE_ADJ, first)).when(v < LOW_VALUE, between(LOW_VALUE_ADJ, first)).otherwise(F.lit(0.0))
    return band + F.when(F.col("state").isin(*VOLATILE_STATES), between(VOLATILE_ADJ, second)).otherwise(F.lit(0.0))


def clip(c: Column, bounds: tuple[float, float]) -> Column:
    return F.least(F.greatest(c, F.lit(bounds[0])), F.lit(bounds[1]))


def intervals(p1: Column, p3: Column) -> dict[str, Column]:
    """SCR-9: prediction +- 1.5 RMSE."""
    m1, m3 = INTERVAL_Z * RMSE_1M, INTERVAL_Z * RMSE_3M
    return {"return_1m_lower": p1 - F.lit(m1), "return_1m_upper": p1 + F.lit(m1),
            "return_3m_lower": p3 - F.lit(m3), "return_3m_upper": p3 + F.lit(m3)}


def risk_simple(p1: Column, p3: Column) -> Column:
    """SCR-10."""
    return F.when((p1 < -2) | (p3 < -5), F.lit("High")).when((p1 > 2) & (p3 > 5), F.lit("Low")) \
        .otherwise(F.lit("Medium"))


def risk_points(p1: Column, p3: Column) -> Column:
    """SCR-11 points on clipped, unrounded predictions."""
    v, r = F.col("current_value"), F.col("recent_rent")
    (g1, g3), (h1, h3) = RISK_GAIN
    f1 = F.when((p1 > g1) | (p3 > g3), F.lit(2)).when((p1 > h1) | (p3 > h3), F.lit(1)).otherwise(F.lit(0))
    (g1, g3), (h1, h3) = RISK_LOSS
    f2 = F.when((p1 < g1) | (p3 < g3), F.lit(3)).when((p1 < h1) | (p3 < h3), F.lit(2)).otherwise(F.lit(0))
    f3 = F.when(v > RISK_VALUES[0], F.lit(1)).when(v < RISK_VALUES[1], F.lit(2)).otherwise(F.lit(0))
    pr = safe_div(v, r * F.lit(12.0))
    f4 = F.when(r.isNotNull() & (r != 0) & ((pr > RISK_RATIOS[0]) | (pr < RISK_RATIOS[1])), F.lit(1)).otherwise(F.lit(0))
    return f1 + f2 + f3 + f4


def risk_category(points: Column) -> Column:
    return F.when(points >= 4, F.lit("High")).when(points >= 2, F.lit("Medium")).otherwise(F.lit("Low"))


@dataclass(frozen=True)
class Forecasters:
    """Fitted models of the 1- and 3-month return and the features they were trained on."""

    model_1m: Any
    model_3m: Any
    features: tuple[str, ...]
    name_1m: str = "model"
    name_3m: str = "model"


def model_forecasts(req: DataFrame, models: Forecasters, as_of: str) -> DataFrame:
    """SCR-2..5 and predict: the request's feature vector in training order (missing
    values are 0, as in training), and both models' predictions as raw_1m and raw_3m."""
    from pyspark.ml.functions import array_to_vector

    known = {**date_features(as_of), **rent_features(), **value_features()}
    cells = [F.coalesce((known[n] if n in known else default_for(n)).cast("double"), F.lit(0.0)) for n in models.features]
    out = req.withColumn("features", array_to_vector(F.array(*cells)))
    for model, name in ((models.model_1m, "raw_1m"), (models.model_3m, "raw_3m")):
        out = model.copy().setPredictionCol(name).transform(out)
    return out.drop("features")


def score(req: DataFrame, latest: DataFrame | None, as_of: str, model_name: str = "persistence",
          models: Forecasters | None = None, draw_seed: int | None = None) -> DataFrame:
    """SCR-1 + SCR-6..12 over a request table: validation, forecast, adjustment (the middle of
    its bounds, or with ``draw_seed`` a reproducible draw between them),
    clipping, rounding, intervals and both risk rules. Forecasts come from fitted
    ``models``, or, without them, from the region's last return: ``latest`` is the latest
    feature row per region (Value, Value_lag_1, Value_lag_3) or None."""
    r = validate_requests(req)
    names = (model_name, model_name)
    if models is not None:
        r, names = model_forecasts(r, models, as_of), (models.name_1m, models.name_3m)
        l1, l3 = F.col("raw_1m"), F.col("raw_3m")
    elif latest is not None:
        lk = latest.select(F.col("RegionName").alias("_region"), F.col("Value").alias("_rv"),
                           F.col("Value_lag_1").alias("_rl1"), F.col("Value_lag_3").alias("_rl3"))
        r = r.withColumn("_region", region_key()).join(lk, "_region", "left").drop("_region")
        l1 = F.coalesce(persistence(F.col("_rv"), F.col("_rl1")), F.lit((1.0 / (1.0 - LAG_DISCOUNT) - 1.0) * 100.0))
        l3 = F.coalesce(persistence(F.col("_rv"), F.col("_rl3")), F.lit((1.0 / (1.0 - 3 * LAG_DISCOUNT) - 1.0) * 100.0))
    else:
        l1 = persistence(F.col("current_value"), F.col("current_value") * F.lit(1.0 - LAG_DISCOUNT))
        l3 = persistence(F.col("current_value"), F.col("current_value") * F.lit(1.0 - 3 * LAG_DISCOUNT))
    r = r.withColumns({"raw_1m": l1, "raw_3m": l3, **market_adjustment()})
    r = r.withColumn("adjustment", F.col("adj_mid") if draw_seed is None else adjustment_draw(draw_seed))
    c1 = clip(F.col("raw_1m") + F.col("adjustment"), CLIP_1M)
    c3 = clip(F.col("raw_3m") + F.col("adjustment"), CLIP_3M)
    r = r.withColumns({"_c1": c1, "_c3": c3})
    pts = risk_points(F.col("_c1"), F.col("_c3"))
    ok = F.col("valid")
    out = r.withColumns({
        "success": ok,
        "error": F.when(~ok, F.col("errors")),
        "return_1m": F.when(ok, round_half_up(F.col("_c1"), 2)),
        "return_3m": F.when(ok, round_half_up(F.col("_c3"), 2)),
        "risk_points": F.when(ok, pts),
        "risk_category": F.when(ok, risk_category(pts)),
        "risk_simple": F.when(ok, risk_simple(F.col("raw_1m"), F.col("raw_3m"))),
        "prediction_id": F.concat(F.lit("pred_"), F.col("request_id").cast("string")),
        "model_version": F.lit(f"1m:{names[0]}, 3m:{names[1]}"),
        "prediction_date": F.lit(as_of).cast("date"),
    })
    out = out.withColumns({k: F.when(ok, v) for k, v in intervals(F.col("raw_1m"), F.col("raw_3m")).items()})
    return out.drop("_c1", "_c3", "_rv", "_rl1", "_rl3")


def batch_summary(scored: DataFrame) -> DataFrame:
    """SCR-13."""
    return scored.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("success")).alias("successful"),
                      F.count_if(~F.col("success")).alias("failed"))


def state_market_summary(scored: DataFrame) -> DataFrame:
    """SCR-14: per state, mean forecasts and risk mix of the successful requests."""
    s = scored.where(F.col("success"))
    return s.groupBy("state").agg(
        F.count(F.lit(1)).alias("requests"), F.avg("return_1m").alias("avg_return_1m"),
        F.avg("return_3m").alias("avg_return_3m"),
        F.count_if(F.col("risk_category") == "High").alias("high_risk"),
        F.count_if(F.col("risk_category") == "Medium").alias("medium_risk"),
        F.count_if(F.col("risk_category") == "Low").alias("low_risk"),
    )
