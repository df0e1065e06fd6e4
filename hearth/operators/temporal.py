"""Calendar, lag, rolling, change, momentum, volatility and trend features
(PRJ-1..4, PRJ-8/9, WIN-1..7).

Every per-region window shares one specification, partition by region and order
by date, so Catalyst plans one exchange and one sort for all of them. Frames
count *rows*, not months (``rowsBetween``), as the reference's shift/rolling do.
A region holds one row per month, so a window partition is bounded by the
calendar (about 300 rows for 25 years), whatever the data volume.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearth.functions.exprs import cyclical, date_parts, market_era, month_distance, safe_div


@dataclass(frozen=True)
class TemporalParams:
    # The reference's periods (in rows = months).
    lags: tuple[int, ...] = (1, 3, 6, 12, 24)
    windows: tuple[int, ...] = (3, 6, 12, 24)
    changes: tuple[int, ...] = (3, 6, 12, 24, 36)
    trends: tuple[int, ...] = (6, 12, 24)
    trend_min_rows: int = 3

    @property
    def reach(self) -> int:
        """Rows that a row's features look at, itself included."""
        return max(*(n + 1 for n in self.lags + self.changes), *self.windows, *self.trends)


DEFAULT = TemporalParams()


def region_window(region: str = "RegionName", date: str = "Date") -> Window:
    return Window.partitionBy(region).orderBy(date)


def _frame(w: Window, n: int) -> Window:
    return w.rowsBetween(-(n - 1), 0)


def calendar_columns(df: DataFrame, date: str = "Date") -> dict[str, Column]:
    """PRJ-1/2: date parts and their cyclical encodings."""
    parts = date_parts(date)
    return {**parts, **cyclical(parts["Month"], parts["Quarter"])}


def with_calendar(df: DataFrame, date: str = "Date") -> DataFrame:
    return df.withColumns(calendar_columns(df, date))


def with_months_since(df: DataFrame, date: str = "Date", bounds: tuple[Column, Column] | None = None) -> DataFrame:
    """PRJ-3: months since the global first / before the global last date.

    The global min/max are scalar subqueries (one tiny aggregate job, its value
    inlined), not a cross join and not an unpartitioned window."""
    if bounds is None:
        lo = df.select(F.min(date)).scalar()
        hi = df.select(F.max(date)).scalar()
    else:
        lo, hi = bounds
    return df.withColumns({
        "MonthsSinceStart": month_distance(F.col(date), lo),
        "MonthsSinceLatest": month_distance(hi, F.col(date)),
    })


def with_market_era(df: DataFrame, date: str = "Date") -> DataFrame:
    """PRJ-4."""
    return df.withColumn("MarketEra", market_era(date))


def window_columns(value: str = "Value", region: str = "RegionName", date: str = "Date",
                   params: TemporalParams = DEFAULT) -> dict[str, Column]:
    """WIN-1..6 as one dict of window expressions over a single window spec."""
    w = region_window(region, date)
    v = F.col(value)
    cols: dict[str, Column] = {}
    for n in params.lags:
        cols[f"{value}_lag_{n}"] = F.lag(v, n).over(w)
    for n in params.windows:
        f = _frame(w, n)
        cols[f"{value}_rolling_mean_{n}"] = F.avg(v).over(f)
        cols[f"{value}_rolling_std_{n}"] = F.stddev_samp(v).over(f)
        cols[f"{value}_rolling_min_{n}"] = F.min(v).over(f)
        cols[f"{value}_rolling_max_{n}"] = F.max(v).over(f)
    for n in params.changes:
        prev = F.lag(v, n).over(w)
        cols[f"{value}_pct_change_{n}"] = safe_div(v, prev) - F.lit(1.0)
        cols[f"{value}_diff_{n}"] = v - prev
    return cols


def recent_rows(df: DataFrame, region: str = "RegionName", date: str = "Date", rows: int = DEFAULT.reach) -> DataFrame:
    """The last ``rows`` rows of each region; Spark drops most others before they are shuffled."""
    back = Window.partitionBy(region).orderBy(F.col(date).desc())
    return df.withColumn("_back", F.row_number().over(back)).where(F.col("_back") <= rows).drop("_back")


def derived_columns(value: str = "Value") -> dict[str, Column]:
    """PRJ-8/9 from the rolling columns."""
    c = lambda s: F.col(f"{value}_{s}")
    return {
        f"{value}_momentum_short": safe_div(c("rolling_mean_3"), c("rolling_mean_12")),
        f"{value}_momentum_long": safe_div(c("rolling_mean_12"), c("rolling_mean_24")),
        f"{value}_volatility_3m": safe_div(c("rolling_std_3"), c("rolling_mean_3")),
        f"{value}_volatility_12m": safe_div(c("rolling_std_12"), c("rolling_mean_12")),
    }


def trend_columns(value: str = "Value", region: str = "RegionName", date: str = "Date", rn: str = "_rn",
                  params: TemporalParams = DEFAULT) -> dict[str, Column]:
    """WIN-7: least-squares slope of value on position over the last k rows,
    NULL until the frame holds ``trend_min_rows`` values (polyfit on 0..k-1 has the
    same slope as on any shifted positions)."""
    w = region_window(region, date)
    v = F.col(value)
    out = {}
    for k in params.trends:
        f = _frame(w, k)
        out[f"{value}_trend_{k}"] = F.when(
            F.count(v).over(f) >= params.trend_min_rows, F.regr_slope(v, F.col(rn).cast("double")).over(f))
    return out


def with_window_features(df: DataFrame, value: str = "Value", region: str = "RegionName", date: str = "Date",
                         params: TemporalParams = DEFAULT) -> DataFrame:
    """WIN-1..7 + PRJ-8/9. Two Window operators over one exchange and one sort: the
    trend slopes need the row number, which is itself a window output."""
    first = {**window_columns(value, region, date, params), "_rn": F.row_number().over(region_window(region, date))}
    df = df.withColumns(first)
    df = df.withColumns({**derived_columns(value), **trend_columns(value, region, date, "_rn", params)})
    return df.drop("_rn")


def temporal_features(df: DataFrame, value: str = "Value", region: str = "RegionName", date: str = "Date",
                      params: TemporalParams = DEFAULT,
                      bounds: tuple[Column, Column] | None = None) -> DataFrame:
    """The reference's ``create_temporal_features``: calendar, months-since, era,
    then all window features, in the reference's column order."""
    df = with_calendar(df, date)
    df = with_months_since(df, date, bounds)
    df = with_market_era(df, date)
    return with_window_features(df, value, region, date, params)


def feature_names(value: str = "Value", params: TemporalParams = DEFAULT) -> list[str]:
    names = ["Year", "Month", "Quarter", "DayOfYear", "WeekOfYear", "Month_sin", "Month_cos", "Quarter_sin",
             "Quarter_cos", "MonthsSinceStart", "MonthsSinceLatest", "MarketEra"]
    names += [f"{value}_lag_{n}" for n in params.lags]
    names += [f"{value}_rolling_{k}_{n}" for n in params.windows for k in ("mean", "std", "min", "max")]
    names += [f"{value}_{k}_{n}" for n in params.changes for k in ("pct_change", "diff")]
    names += [f"{value}_momentum_short", f"{value}_momentum_long", f"{value}_volatility_3m", f"{value}_volatility_12m"]
    names += [f"{value}_trend_{k}" for k in params.trends]
    return names
