"""Forward-looking targets (WIN-8, PRJ-10..12) and the training-row filter (TRN-1)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearth.functions.exprs import direction, return_category, safe_div
from hearth.operators.temporal import region_window

# Forecast horizons in months (rows).
HORIZONS = (1, 3, 6, 12)


def target_names(horizons=HORIZONS) -> list[str]:
    return [f"target_{k}_{h}m" for h in horizons for k in ("value", "return", "direction", "category")]


def target_columns(value: str = "Value", region: str = "RegionName", date: str = "Date",
                   horizons=HORIZONS) -> dict[str, Column]:
    w = region_window(region, date)
    v = F.col(value)
    cols: dict[str, Column] = {}
    for h in horizons:
        fut = F.lead(v, h).over(w)
        ret = (safe_div(fut, v) - F.lit(1.0)) * F.lit(100.0)
        cols[f"target_value_{h}m"] = fut
        cols[f"target_return_{h}m"] = ret
        cols[f"target_direction_{h}m"] = direction(ret)
        cols[f"target_category_{h}m"] = return_category(ret)
    return cols


def with_targets(df: DataFrame, value: str = "Value", region: str = "RegionName", date: str = "Date",
                 horizons=HORIZONS) -> DataFrame:
    """The reference's ``create_target_variables``. Shares the per-region window of
    the temporal features, so it adds no exchange when applied after them."""
    return df.withColumns(target_columns(value, region, date, horizons))


def training_rows(df: DataFrame, horizons=HORIZONS) -> DataFrame:
    """TRN-1: rows whose every future value exists."""
    return df.dropna(subset=[f"target_value_{h}m" for h in horizons])
