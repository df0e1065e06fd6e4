"""Registered queries: panels, temporal windows, targets."""

from __future__ import annotations


from hearth.operators import targets as tg
from hearth.operators import temporal as tm
from hearth.operators.geographic import with_state_rank, with_value_rank_in_state, join_state_stats
from hearth.plans import oracle as O
from hearth.plans.registry import register
from hearth.session import materialize
from hearth.sources import panels as P

KEY = ["RegionName", "Date", "Value"]
KEY_SQL = "RegionName, Date, " + O.rnd("Value") + " AS Value"


def _home(spark, sf):
    return P.home_panel(spark, sf)


def _home_shared(spark, sf):
    """The home panel for plans that read it in several branches."""
    return materialize(P.home_panel(spark, sf))


def _sel(df, cols):
    return df.select(*KEY, *cols)


# --- panels ---------------------------------------------------------------------------------------------------

def _panel_sql(name):
    cols = [O.rnd("Value") + " AS Value" if c == "Value" else c for c in O.LONG_COLS]
    return O.with_panels(f"SELECT {', '.join(cols)} FROM {name}", name)


for _name in ("home", "rent", "inventory", "sales"):
    register(f"panel_{_name}", _panel_sql(_name))(lambda spark, sf, _n=_name: P.panel(spark, sf, _n))


# --- WIN-1..7 -------------------------------------------------------------------------------------------------

def _window_query(name, pairs, cols):
    sql = O.with_panels(f"SELECT {KEY_SQL},\n  {O.select_list(pairs)}\nFROM home", "home")

    @register(name, sql)
    def _q(spark, sf):
        df = _home(spark, sf).withColumns({c: e for c, e in tm.window_columns().items() if c in cols})
        return _sel(df, cols)
    return _q


_lag = O.lag_exprs()
_window_query("lags", _lag, [c for c, _ in _lag])
_roll = O.rolling_exprs(kinds=("mean",))
_window_query("rolling_mean", _roll, [c for c, _ in _roll])
_roll = O.rolling_exprs(kinds=("std",))
_window_query("rolling_std", _roll, [c for c, _ in _roll])
_roll = O.rolling_exprs(kinds=("min", "max"))
_window_query("rolling_min_max", _roll, [c for c, _ in _roll])
_chg = O.change_exprs(kinds=("pct_change",))
_window_query("pct_change", _chg, [c for c, _ in _chg])
_chg = O.change_exprs(kinds=("diff",))
_window_query("value_diff", _chg, [c for c, _ in _chg])


_trend_cols = [c for c, _ in O.trend_exprs()]


@register("rolling_trend", O.with_panels(
    f"SELECT {KEY_SQL},\n  {O.select_list(O.trend_exprs())}\n"
    f"FROM (SELECT *, row_number() OVER ({O.W}) AS _rn FROM home) h", "home"))
def rolling_trend(spark, sf):
    df = tm.with_window_features(_home(spark, sf))
    return _sel(df, _trend_cols)


def _derived_sql(kind):
    f = {f"f{n}": O.frame(n) for n in (3, 12, 24)}
    if kind == "momentum":
        pairs = [("Value_momentum_short", "avg(Value) OVER {f3} / nullif(avg(Value) OVER {f12}, 0)"),
                 ("Value_momentum_long", "avg(Value) OVER {f12} / nullif(avg(Value) OVER {f24}, 0)")]
    else:
        pairs = [("Value_volatility_3m", "stddev_samp(Value) OVER {f3} / nullif(avg(Value) OVER {f3}, 0)"),
                 ("Value_volatility_12m", "stddev_samp(Value) OVER {f12} / nullif(avg(Value) OVER {f12}, 0)")]
    pairs = [(n, e.format(**f)) for n, e in pairs]
    return O.with_panels(f"SELECT {KEY_SQL},\n  {O.select_list(pairs)}\nFROM home", "home")


@register("momentum", _derived_sql("momentum"))
def momentum(spark, sf):
    return _sel(tm.with_window_features(_home(spark, sf)), ["Value_momentum_short", "Value_momentum_long"])


@register("volatility", _derived_sql("volatility"))
def volatility(spark, sf):
    return _sel(tm.with_window_features(_home(spark, sf)), ["Value_volatility_3m", "Value_volatility_12m"])


# --- PRJ-1..4 -------------------------------------------------------------------------------------------------

_DATE_PARTS_SQL = """CAST(year(Date) AS INTEGER) AS Year, CAST(month(Date) AS INTEGER) AS Month,
  CAST(quarter(Date) AS INTEGER) AS Quarter, CAST(dayofyear(Date) AS INTEGER) AS DayOfYear,
  CAST(weekofyear(Date) AS INTEGER) AS WeekOfYear"""


@register("date_parts", O.with_panels(f"SELECT {KEY_SQL}, {_DATE_PARTS_SQL} FROM home", "home"))
def date_parts(spark, sf):
    return _sel(tm.with_calendar(_home(spark, sf)), ["Year", "Month", "Quarter", "DayOfYear", "WeekOfYear"])


_CYC = [("Month_sin", "sin(2 * pi() * month(Date) / 12.0)"), ("Month_cos", "cos(2 * pi() * month(Date) / 12.0)"),
        ("Quarter_sin", "sin(2 * pi() * quarter(Date) / 4.0)"), ("Quarter_cos", "cos(2 * pi() * quarter(Date) / 4.0)")]


@register("cyclical_encoding", O.with_panels(f"SELECT {KEY_SQL}, {O.select_list(_CYC)} FROM home", "home"))
def cyclical_encoding(spark, sf):
    return _sel(tm.with_calendar(_home(spark, sf)), [c for c, _ in _CYC])


@register("months_since", O.with_panels(
    f"SELECT {KEY_SQL}, {O.months_since_sql('home')} FROM home", "home"))
def months_since(spark, sf):
    return _sel(tm.with_months_since(_home(spark, sf)), ["MonthsSinceStart", "MonthsSinceLatest"])


@register("market_era", O.with_panels(f"SELECT {KEY_SQL}, {O.ERA_SQL} AS MarketEra FROM home", "home"))
def market_era(spark, sf):
    return _sel(tm.with_market_era(_home(spark, sf)), ["MarketEra"])


# --- WIN-8, PRJ-10..12 ----------------------------------------------------------------------------------------

_tgt = O.target_exprs()
_tgt_doubles = {c for c, _ in _tgt if c.startswith(("target_value", "target_return"))}


def _target_query(name, prefixes):
    pairs = [(c, e) for c, e in _tgt if c.startswith(prefixes)]
    sql = O.with_panels(f"SELECT {KEY_SQL},\n  {O.select_list(pairs, _tgt_doubles)}\nFROM home", "home")

    @register(name, sql)
    def _q(spark, sf):
        df = tg.with_targets(_home(spark, sf))
        return _sel(df, [c for c, _ in pairs])
    return _q


_target_query("future_values", ("target_value",))
_target_query("future_returns", ("target_return",))
_target_query("future_direction", ("target_direction",))
_target_query("future_category", ("target_category",))


# --- WIN-9/10 -------------------------------------------------------------------------------------------------

@register("value_rank_in_state", O.with_panels(
    f"SELECT {KEY_SQL}, StateName, "
    + O.rnd("(rank() OVER (PARTITION BY StateName, Date ORDER BY Value) - 1 "
            "+ (count(*) OVER (PARTITION BY StateName, Date, Value) + 1) / 2.0) "
            "/ count(*) OVER (PARTITION BY StateName, Date)")
    + " AS ValueRankInState FROM home", "home"))
def value_rank_in_state(spark, sf):
    return with_value_rank_in_state(_home_shared(spark, sf)).select(*KEY, "StateName", "ValueRankInState")


@register("state_rank", O.with_panels(
    "SELECT RegionName, Date, " + O.rnd("Value") + " AS Value, StateName, State_count, "
    + O.rnd("rank() OVER (PARTITION BY Date ORDER BY State_count DESC) - 1 "
            "+ (count(*) OVER (PARTITION BY Date, State_count) + 1) / 2.0")
    + " AS StateRank FROM (SELECT h.*, CAST(count(Value) OVER (PARTITION BY StateName) AS DOUBLE) AS State_count "
      "FROM home h) x", "home"))
def state_rank(spark, sf):
    df = with_state_rank(join_state_stats(_home_shared(spark, sf)))
    return df.select(*KEY, "StateName", "State_count", "StateRank")
