"""Market panel: home values joined with rent, state supply/demand and national
statistics (JN-1..4, PRJ-5..7, AGG-10/11).

Every right side except rent is aggregated before the join, to (state, month) or
(month) -- bounded by the calendar and the number of states -- and written, so its size is
known when the join is planned: broadcast under the limit, sort-merge beyond it. The rent join is a region x month equi-join of two panels and
shuffles on its keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearth.functions.exprs import MEDIAN_INCOME, RENT_MULTIPLE, safe_div
from hearth.operators.order_stats import group_stats
from hearth.session import materialize, together


def join_rent(home: DataFrame, rent: DataFrame, keys=("RegionName", "Date")) -> DataFrame:
    """JN-1 + PRJ-5. LEFT JOIN on (region, date); NULL keys match each other, as in
    a pandas merge (null-safe equality is still a hashable equi-join key)."""
    r = rent.select(*[F.col(k).alias(f"_r_{k}") for k in keys], F.col("Value").alias("Rent"))
    cond = None
    for k in keys:
        c = home[k].eqNullSafe(r[f"_r_{k}"])
        cond = c if cond is None else cond & c
    j = home.join(r, cond, "left").drop(*[f"_r_{k}" for k in keys])
    return with_price_rent_metrics(j)


def with_price_rent_metrics(df: DataFrame, value: str = "Value", rent: str = "Rent") -> DataFrame:
    """PRJ-5: price-to-rent ratio (NULL on a zero rent), affordability, spread."""
    annual = F.col(rent) * F.lit(12.0)
    return df.withColumns({
        "PriceToRentRatio": safe_div(F.col(value), annual),
        "RentAffordabilityRatio": annual / F.lit(MEDIAN_INCOME),
        "PriceRentSpread": F.col(value) - annual * F.lit(RENT_MULTIPLE),
    })


def state_month_volume(panel: DataFrame, label: str) -> DataFrame:
    """AGG-10: per (StateName, Date) mean and sum of a volume panel."""
    return panel.where(F.col("StateName").isNotNull() & F.col("Date").isNotNull()).groupBy("StateName", "Date").agg(
        F.avg("Value").alias(f"State_{label}_Mean"), F.sum("Value").alias(f"State_{label}_Total"))


def join_state_volume(df: DataFrame, panel: DataFrame, label: str) -> DataFrame:
    """JN-2 / JN-3: LEFT JOIN the state-month volume aggregate."""
    return df.join(materialize(state_month_volume(panel, label), "volume"), ["StateName", "Date"], "left")


def with_market_velocity(df: DataFrame) -> DataFrame:
    """PRJ-6: months of supply and its inverse, NULL on a zero denominator."""
    return df.withColumns({
        "MonthsOfSupply": safe_div("State_Inventory_Total", "State_Sales_Total"),
        "MarketLiquidity": safe_div("State_Sales_Total", "State_Inventory_Total"),
    })


def national_by_month(df: DataFrame, value: str = "Value", date: str = "Date") -> DataFrame:
    """AGG-11: per-month mean, exact median and sample std."""
    return group_stats(df, [date], value, prefix="National_", stats=("mean", "median", "std"))


def join_national(df: DataFrame, value: str = "Value", date: str = "Date", stats: DataFrame | None = None) -> DataFrame:
    """JN-4 + PRJ-7. ``stats`` may give the national table, made of the same rows through
    a shorter plan (see ``market_panel``)."""
    # one row per month, written first: its size is known before the wide side would move
    if stats is None:
        stats = materialize(national_by_month(df, value, date), "national")
    j = df.join(stats, [date], "left")
    return j.withColumns({
        "ValueVsNational": safe_div(F.col(value), F.col("National_mean")),
        "ValueVsNationalMedian": safe_div(F.col(value), F.col("National_median")),
    })


def market_panel(home: DataFrame, rent: DataFrame | None = None, inventory: DataFrame | None = None,
                 sales: DataFrame | None = None, rent_unique: bool = True) -> DataFrame:
    """The reference's ``create_market_dynamics_features``; optional inputs add
    their columns only when present.

    ``rent_unique``: the rent panel has one row per (RegionName, Date), as every
    panel of ``hearth.sources.panels`` has (they are grouped on those keys). The
    state volumes are grouped on their join keys too, so all LEFT JOINs keep
    exactly the home rows and the national statistics can read the home panel
    instead of a second copy of the joined plan. Pass False for a rent table
    with repeated keys: the statistics then see the duplicated rows, as in the
    reference's merge."""
    # the small sides do not need each other: they are written at the same time
    volumes = {label: side for label, side in (("Inventory", inventory), ("Sales", sales)) if side is not None and "StateName" in side.columns}
    jobs = [lambda side=side, label=label: materialize(state_month_volume(side, label), "volume") for label, side in volumes.items()]
    if rent is None or rent_unique:
        jobs.append(lambda: materialize(national_by_month(home.select("Date", "Value")), "national"))
    written = together(*jobs)
    df = home if rent is None else join_rent(home, rent)
    for table in written[:len(volumes)]:
        df = df.join(table, ["StateName", "Date"], "left")
    if len(volumes) == 2:
        df = with_market_velocity(df)
    return join_national(df, stats=written[-1] if len(written) > len(volumes) else None)
