"""Column-expression builders. Everything here is a native Catalyst expression
(whole-stage codegen), never a Python UDF."""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's results.
# Market-era boundaries (strictly-less-than, each on January 1st) and labels.
ERA_BOUNDARIES = (("2008-01-01", "pre_crisis"), ("2012-01-01", "crisis_recovery"),
                  ("2020-01-01", "post_crisis"), ("2022-01-01", "covid_boom"))
ERA_LAST = "post_covid"
# Return-category thresholds (strict <): <-5 -> 0, <-1 -> 1, <1 -> 2, <5 -> 3, else 4.
CATEGORY_THRESHOLDS = (-5.0, -1.0, 1.0, 5.0)
# Average days per month used for month distances.
DAYS_PER_MONTH = 30.44
# Constant income used for rent affordability, and the 20x-rent rule.
MEDIAN_INCOME = 70000.0
RENT_MULTIPLE = 20.0
# ---------------------------------------------------------------------------


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_div(num: str | Column, den: str | Column) -> Column:
    """num / den, NULL where den is 0 or NULL (never +-inf, never an ANSI error)."""
    return F.try_divide(col(num), col(den))


def round_half_up(c: str | Column, scale: int) -> Column:
    """floor(x * 10^s + 0.5) / 10^s.

    Written as plain IEEE arithmetic so that any two engines given the same double
    return the same double (the built-in ``round`` of different engines disagrees on
    short decimals lying on a half, e.g. 0.285)."""
    m = float(10 ** scale)
    return (F.floor(col(c) * F.lit(m) + F.lit(0.5)).cast("double") / F.lit(m)).cast("double")


def round_doubles(df: DataFrame, scale: int = 4, overrides: dict[str, int] | None = None) -> DataFrame:
    """Apply ``round_half_up`` to every double column (report output only)."""
    overrides = overrides or {}
    exprs = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            exprs.append(round_half_up(F.col(f"`{f.name}`"), overrides.get(f.name, scale)).alias(f.name))
        else:
            exprs.append(F.col(f"`{f.name}`"))
    return df.select(*exprs)


def market_era(date_col: str | Column = "Date") -> Column:
    d = col(date_col)
    expr = None
    for bound, label in ERA_BOUNDARIES:
        cond = d < F.lit(bound).cast("date")
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return F.when(d.isNull(), F.lit(None).cast("string")).otherwise(expr.otherwise(F.lit(ERA_LAST)))


def return_category(ret: str | Column) -> Column:
    r = col(ret)
    t0, t1, t2, t3 = CATEGORY_THRESHOLDS
    return (
        F.when(r.isNull() | F.isnan(r), F.lit(None).cast("int"))
        .when(r < t0, F.lit(0)).when(r < t1, F.lit(1)).when(r < t2, F.lit(2)).when(r < t3, F.lit(3))
        .otherwise(F.lit(4))
    ).cast("int")


def direction(ret: str | Column) -> Column:
    """1 if ret > 0 else 0; an unknown future counts as 0 (comparison with NaN is false)."""
    return F.coalesce((col(ret) > 0).cast("int"), F.lit(0))


def date_parts(date_col: str | Column = "Date") -> dict[str, Column]:
    d = col(date_col)
    return {
        "Year": F.year(d),
        "Month": F.month(d),
        "Quarter": F.quarter(d),
        "DayOfYear": F.dayofyear(d),
        "WeekOfYear": F.weekofyear(d),  # ISO-8601 week, same as isocalendar().week
    }


def cyclical(month: str | Column = "Month", quarter: str | Column = "Quarter") -> dict[str, Column]:
    two_pi = 2.0 * math.pi
    m, q = col(month).cast("double"), col(quarter).cast("double")
    return {
        "Month_sin": F.sin(F.lit(two_pi) * m / F.lit(12.0)),
        "Month_cos": F.cos(F.lit(two_pi) * m / F.lit(12.0)),
        "Quarter_sin": F.sin(F.lit(two_pi) * q / F.lit(4.0)),
        "Quarter_cos": F.cos(F.lit(two_pi) * q / F.lit(4.0)),
    }


def month_distance(later: str | Column, earlier: str | Column) -> Column:
    """round(days / 30.44) as double. days/30.44 is never exactly k+0.5 for integral
    days, so half-even and half-up agree."""
    return F.round(F.datediff(col(later), col(earlier)).cast("double") / F.lit(DAYS_PER_MONTH)).cast("double")


def all_not_null(cols: Iterable[str]) -> Column:
    cond = F.lit(True)
    for c in cols:
        cond = cond & F.col(c).isNotNull()
    return cond
