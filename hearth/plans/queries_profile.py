"""Registered queries: profiling, quality, top-k, set operations, correlations,
cleaning (SURVEY 2.1 SRC-4/8/9, 2.2 RSH-6, 2.5, 2.7, 2.8)."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from hearth.operators import profile as pf
from hearth.plans import oracle as O
from hearth.plans.registry import register
from hearth.schema import LONG_SCHEMA, DatasetRegistry
from hearth.sources import clean as C
from hearth.session import materialize, scratch_path
from hearth.sources import panels as P

R = O.rnd
ALL4 = ("home", "rent", "inventory", "sales")
ALLP = "allp AS (SELECT * FROM home UNION ALL SELECT * FROM rent UNION ALL SELECT * FROM inventory " \
       "UNION ALL SELECT * FROM sales)"


def _all(body):
    return O.with_panels(f", {ALLP}\n{body}", *ALL4)


def _stack(spark, sf, names=ALL4):
    shared = P.FROM_FACTS.keys() & set(names)
    # two or three of these panels come from one lineitem pass
    facts = materialize(P.supplier_month_facts(spark, sf), "facts") if len(shared) > 1 else None
    out = None
    for n in names:
        p = P.FROM_FACTS[n](facts, spark, sf) if facts is not None and n in shared else P.panel(spark, sf, n)
        out = p if out is None else out.unionByName(p)
    return out


def _stack_shared(spark, sf, names=ALL4):
    """Stacked panels for plans that read them in several branches."""
    return materialize(_stack(spark, sf, names))


# --- AGG-1..3 ----------------------------------------------------------------------------------------------------

@register("dataset_overview", _all(
    "SELECT Dataset, count(*) AS Total_Rows, count(DISTINCT RegionName) AS Unique_Regions, min(Date) AS Date_Min, "
    "max(Date) AS Date_Max, count(*) FILTER (WHERE Value IS NULL) AS Missing_Values, "
    f"{R('min(Value)')} AS Min_Value, {R('max(Value)')} AS Max_Value, "
    f"{R('CAST(count(*) FILTER (WHERE Value IS NULL) AS DOUBLE) / CAST(count(*) AS DOUBLE) * 100.0')} AS Missing_Pct, "
    f"{R('median(Value)')} AS Median_Value FROM allp GROUP BY Dataset"))
def dataset_overview(spark, sf):
    return pf.dataset_overview(_stack_shared(spark, sf))


_REG = DatasetRegistry()
_META = " UNION ALL ".join(f"SELECT '{n}' AS Dataset, '{d}' AS Description, '{g}' AS Geography"
                           for _, n, d, g in _REG.as_rows())


@register("dataset_summary", _all(
    "SELECT a.*, m.Description, m.Geography FROM (SELECT Dataset, count(*) AS Rows, count(Value) AS Non_Null_Values, "
    "count(DISTINCT RegionName) AS Unique_Regions, min(Date) AS Date_Range_Start, max(Date) AS Date_Range_End, "
    f"{R('min(Value)')} AS Value_Range_Min, {R('max(Value)')} AS Value_Range_Max FROM allp GROUP BY Dataset) a "
    f"LEFT JOIN ({_META}) m ON a.Dataset = m.Dataset"))
def dataset_summary(spark, sf):
    return pf.dataset_summary(_stack_shared(spark, sf))


@register("value_describe", _all(
    f"SELECT Dataset, CAST(count(Value) AS DOUBLE) AS count, {R('avg(Value)')} AS mean, {R('stddev_samp(Value)')} AS std, "
    f"{R('min(Value)')} AS min, {R('quantile_cont(Value, 0.25)')} AS p25, {R('quantile_cont(Value, 0.5)')} AS p50, "
    f"{R('quantile_cont(Value, 0.75)')} AS p75, {R('max(Value)')} AS max FROM allp GROUP BY Dataset"))
def value_describe(spark, sf):
    return pf.value_describe(_stack_shared(spark, sf))


# --- AGG-4..7 ----------------------------------------------------------------------------------------------------

def _monthly_sql(names, third):
    src = " UNION ALL ".join(f"SELECT * FROM {n}" for n in names)
    third_sql = "count(Value) AS count" if third == "count" else f"{R('sum(Value)')} AS sum"
    return (f"SELECT Dataset, Date, {R('avg(Value)')} AS mean, {R('median(Value)')} AS median, {third_sql} "
            f"FROM ({src}) s WHERE Date IS NOT NULL GROUP BY Dataset, Date")


@register("monthly_value_trend", O.with_panels(_monthly_sql(("home", "rent"), "count"), "home", "rent"))
def monthly_value_trend(spark, sf):
    return pf.monthly_trend(_stack_shared(spark, sf, ("home", "rent")))


@register("monthly_volume_trend", O.with_panels(_monthly_sql(("inventory", "sales"), "sum"), "inventory", "sales"))
def monthly_volume_trend(spark, sf):
    return pf.monthly_trend(_stack_shared(spark, sf, ("inventory", "sales")), volume=True)


def _raw_monthly_sql(names, third):
    src = " UNION ALL ".join(f"SELECT * FROM {n}" for n in names)
    return (f"SELECT Dataset, Date, avg(Value) AS mean, median(Value) AS median, {third}(Value) AS {third} "
            f"FROM ({src}) s WHERE Date IS NOT NULL GROUP BY Dataset, Date")


@register("trend_headline", O.with_panels(
    f"SELECT Dataset, count(*) AS points, max(Date) FILTER (WHERE k = 1) AS latest_date, "
    f"{R('max(median) FILTER (WHERE k = 1)')} AS latest_median, {R('max(median) FILTER (WHERE k = 60)')} AS median_back, "
    f"{R('(max(median) FILTER (WHERE k = 1) / nullif(max(median) FILTER (WHERE k = 60), 0) - 1.0) * 100.0')} AS change_pct "
    f"FROM (SELECT *, row_number() OVER (PARTITION BY Dataset ORDER BY Date DESC) AS k "
    f"FROM ({_raw_monthly_sql(('home', 'rent'), 'count')}) m) x GROUP BY Dataset", "home", "rent"))
def trend_headline(spark, sf):
    return pf.trend_headline(pf.monthly_trend(_stack_shared(spark, sf, ("home", "rent"))))


@register("volume_headline", O.with_panels(
    f"SELECT Dataset, max(Date) AS latest_date, {R('arg_max(sum, Date)')} AS latest_total, {R('max(sum)')} AS peak_total "
    f"FROM ({_raw_monthly_sql(('inventory', 'sales'), 'sum')}) m GROUP BY Dataset", "inventory", "sales"))
def volume_headline(spark, sf):
    return pf.volume_headline(pf.monthly_trend(_stack(spark, sf, ("inventory", "sales")), volume=True))


# --- AGG-8/9, SRT-2/3 ----------------------------------------------------------------------------------------------

_STATE_COV = ("SELECT StateName, count(DISTINCT RegionName) AS Unique_Regions, count(Value) AS Total_Observations, "
              "round_even(median(Value), 0) AS Median_Value FROM home WHERE StateName IS NOT NULL GROUP BY StateName")
_METRO_INV = ("SELECT RegionName, round_even(avg(Value), 0) AS Avg_Inventory, round_even(max(Value), 0) AS Peak_Inventory, "
              "round_even(stddev_samp(Value), 0) AS Volatility FROM inventory WHERE RegionName IS NOT NULL "
              "GROUP BY RegionName")


@register("state_coverage", O.with_panels(_STATE_COV, "home"))
def state_coverage(spark, sf):
    return pf.state_coverage(materialize(P.home_panel(spark, sf)))


@register("top_states", O.with_panels(
    f"SELECT * FROM ({_STATE_COV}) s ORDER BY Unique_Regions DESC, StateName LIMIT 10", "home"))
def top_states(spark, sf):
    return pf.top_k(pf.state_coverage(materialize(P.home_panel(spark, sf))), "Unique_Regions", "StateName")


@register("metro_inventory_stats", O.with_panels(_METRO_INV, "inventory"))
def metro_inventory_stats(spark, sf):
    return pf.metro_inventory_stats(P.inventory_panel(spark, sf))


@register("top_metros", O.with_panels(
    f"SELECT * FROM ({_METRO_INV}) s ORDER BY Avg_Inventory DESC, RegionName LIMIT 10", "inventory"))
def top_metros(spark, sf):
    return pf.top_k(pf.metro_inventory_stats(P.inventory_panel(spark, sf)), "Avg_Inventory", "RegionName")


# --- JN-8, SRT-4, SET-1/2, AGG-19 ------------------------------------------------------------------------------------

_RATIOS = ("SELECT h.RegionName, h.Value AS HomeValue, r.Value AS Rent, h.Value / nullif(r.Value * 12.0, 0) AS ratio "
           "FROM (SELECT * FROM home WHERE Date = (SELECT max(Date) FROM home)) h "
           "JOIN (SELECT * FROM rent WHERE Date = (SELECT max(Date) FROM rent)) r ON h.RegionName = r.RegionName")


def _ratios(spark, sf):
    # read two to five times by each query: written once
    return materialize(pf.latest_price_to_rent(P.home_panel(spark, sf), P.rent_panel(spark, sf)), "ratios")


@register("price_to_rent_latest", O.with_panels(
    f"SELECT count(ratio) AS regions, {R('min(ratio)')} AS min_ratio, {R('max(ratio)')} AS max_ratio, "
    f"{R('median(ratio)')} AS median_ratio FROM ({_RATIOS}) x", "home", "rent"))
def price_to_rent_latest(spark, sf):
    return pf.price_to_rent_summary(_ratios(spark, sf))


_R4 = f"RegionName, {R('HomeValue')} AS HomeValue, {R('Rent')} AS Rent, {R('ratio')} AS ratio"


@register("extreme_price_to_rent", O.with_panels(
    f"SELECT {_R4}, 'lowest' AS side FROM (SELECT * FROM ({_RATIOS}) a ORDER BY ratio, RegionName LIMIT 10) lo "
    f"UNION ALL SELECT {_R4}, 'highest' AS side FROM (SELECT * FROM ({_RATIOS}) b ORDER BY ratio DESC, RegionName "
    "LIMIT 10) hi", "home", "rent"))
def extreme_price_to_rent(spark, sf):
    return pf.extreme_ratios(_ratios(spark, sf))


@register("ratio_histogram", O.with_panels(
    f"SELECT CAST(b.bin AS INTEGER) AS bin, {R('lo + (hi - lo) * CAST(b.bin AS DOUBLE) / 50.0')} AS bin_start, "
    f"{R('lo + (hi - lo) * CAST(b.bin + 1 AS DOUBLE) / 50.0')} AS bin_end, CAST(coalesce(c.n, 0) AS BIGINT) AS count "
    f"FROM range(50) b(bin) CROSS JOIN (SELECT min(ratio) AS lo, max(ratio) AS hi FROM ({_RATIOS}) q) mm "
    f"LEFT JOIN (SELECT CAST(least(floor((ratio - (SELECT min(ratio) FROM ({_RATIOS}) q1)) / "
    f"((SELECT max(ratio) FROM ({_RATIOS}) q2) - (SELECT min(ratio) FROM ({_RATIOS}) q3)) * 50.0), 49) AS INTEGER) AS bin, "
    f"count(*) AS n FROM ({_RATIOS}) q4 WHERE ratio IS NOT NULL GROUP BY 1) c ON c.bin = b.bin "
    "WHERE mm.lo IS NOT NULL", "home", "rent"))
def ratio_histogram(spark, sf):
    return pf.histogram(_ratios(spark, sf), "ratio")


@register("common_regions", O.with_panels(
    "SELECT RegionName FROM home INTERSECT SELECT RegionName FROM rent", "home", "rent"))
def common_regions(spark, sf):
    return pf.common_regions(P.home_panel(spark, sf), P.rent_panel(spark, sf))


@register("distinct_dates", _all(
    "SELECT Dataset, Date FROM (SELECT Dataset, Date, row_number() OVER (PARTITION BY Dataset ORDER BY Date) AS k "
    "FROM (SELECT DISTINCT Dataset, Date FROM allp) d) x WHERE k <= 10"))
def distinct_dates(spark, sf):
    return pf.distinct_dates(_stack(spark, sf))


_LONG_SEL = ", ".join(R(c) + " AS Value" if c == "Value" else c for c in O.LONG_COLS)


@register("sample_rows", O.with_panels(" UNION ALL ".join(
    f"SELECT * FROM (SELECT {_LONG_SEL} FROM {n} ORDER BY RegionName, Date LIMIT 10) s{i}"
    for i, n in enumerate(ALL4)), *ALL4))
def sample_rows(spark, sf):
    out = None
    for n in ALL4:
        s = pf.sample_rows(P.panel(spark, sf, n))
        out = s if out is None else out.unionByName(s)
    return out


_TYPES = {f.name: f.dataType.simpleString() for f in LONG_SCHEMA.fields}


@register("column_inventory", _all(
    "SELECT u.Dataset, t.column_name, t.data_type, t.position, u.non_null FROM (UNPIVOT (SELECT Dataset AS _ds, "
    + ", ".join(f"count({c}) AS c_{c}" for c in O.LONG_COLS)
    + " FROM allp GROUP BY Dataset) ON " + ", ".join(f"c_{c}" for c in O.LONG_COLS)
    + " INTO NAME k VALUE non_null) u0 CROSS JOIN LATERAL (SELECT u0._ds AS Dataset, substr(u0.k, 3) AS cn, "
    "u0.non_null AS non_null) u "
    "JOIN (" + " UNION ALL ".join(f"SELECT '{c}' AS column_name, '{_TYPES[c]}' AS data_type, {i} AS position"
                                  for i, c in enumerate(O.LONG_COLS)) + ") t ON u.cn = t.column_name"))
def column_inventory(spark, sf):
    """SRC-9: column names, types and positions with per-dataset non-null counts."""
    df = _stack(spark, sf)
    cols = O.LONG_COLS
    counts = df.select(F.col("Dataset").alias("_ds"), *cols).groupBy("_ds").agg(*[F.count(c).alias(c) for c in cols])
    long = counts.unpivot(["_ds"], cols, "column_name", "non_null").withColumnRenamed("_ds", "Dataset")
    types = spark.createDataFrame([(c, t, i) for i, (c, t) in enumerate(df.dtypes)],
                                  "column_name string, data_type string, position int")
    return long.join(F.broadcast(types), "column_name").select("Dataset", "column_name", "data_type", "position",
                                                                 "non_null")


# --- dirty panel: cleaning and quality (SRC-4, RSH-6, AGG-13..17) -------------------------------------------------

DIRTY = f"""
dirty_txt AS (
  SELECT RegionID, SizeRank, RegionName, RegionType, StateName, State, Metro, CountyName,
         CASE WHEN RegionID % 13 = 0 AND month(Date) = 1 THEN 'not-a-date' ELSE strftime(Date, '%Y-%m-%d') END AS Date,
         CASE WHEN RegionID % 11 = 0 AND month(Date) = 6 THEN 'n/a' ELSE CAST({R('v', 2)} AS VARCHAR) END AS Value,
         Dataset, GeographyLevel
  FROM (SELECT *, CASE WHEN RegionID % 19 = 0 THEN Value * 100 ELSE Value END AS v FROM home) h
),
dirty AS (SELECT * FROM dirty_txt UNION ALL SELECT * FROM dirty_txt WHERE RegionID % 7 = 0 AND substr(Date, 6, 2) = '03'),
cleaned AS (
  SELECT RegionID, SizeRank, RegionName, RegionType, StateName, State, Metro, CountyName, d AS Date, v AS Value,
         Dataset, GeographyLevel
  FROM (SELECT *, coalesce(TRY_CAST(try_strptime(trim(Date), '%Y-%m-%d') AS DATE),
                           TRY_CAST(try_strptime(trim(Date), '%m/%d/%Y') AS DATE)) AS d,
               TRY_CAST(trim(Value) AS DOUBLE) AS v FROM dirty) x
  WHERE d IS NOT NULL AND v IS NOT NULL AND NOT isnan(v)
)"""


def _dirty(body):
    return O.with_panels(f",{DIRTY}\n{body}", "home")


def _cleaned(spark, sf):
    """Cleaned dirty panel; every quality query reads it in several branches."""
    return materialize(C.clean_long(P.dirty_panel(spark, sf)))


@register("clean_long", _dirty(f"SELECT {_LONG_SEL} FROM cleaned"))
def clean_long(spark, sf):
    return C.clean_long(P.dirty_panel(spark, sf))


_PARSED = ("SELECT *, coalesce(TRY_CAST(try_strptime(trim(Date), '%Y-%m-%d') AS DATE), TRY_CAST(try_strptime(trim(Date), '%m/%d/%Y') AS DATE)) AS d, "
           "TRY_CAST(trim(Value) AS DOUBLE) AS v FROM dirty")


@register("quarantine_read", _dirty(
    f"SELECT reason, count(*) AS rows, {R('coalesce(sum(v), 0)', 2)} AS total_value FROM (SELECT CASE WHEN d IS NULL THEN 'date' WHEN v IS NULL THEN 'value' ELSE 'kept' END "
    f"|| CASE WHEN d IS NULL AND v IS NULL THEN ', value' ELSE '' END AS reason, CASE WHEN d IS NOT NULL THEN v END AS v FROM ({_PARSED}) x) y GROUP BY reason "
    "UNION ALL SELECT 'lines', count(*), 0.0 FROM dirty"), overrides={"total_value": 2})
def quarantine_read(spark, sf):
    """SRC-4, RSH-7/8: the dirty panel as CSV, read with types; rejected lines are kept with their reason."""
    root = scratch_path(spark, "dirty-csv")
    P.dirty_panel(spark, sf).write.option("header", True).csv(root)
    rows, rejects = C.read_quarantined(spark, root)
    out = scratch_path(spark, "quarantine")
    rejects.write.parquet(out)  # rejects are a table, not a log line
    none = F.lit(0.0).alias("total_value")
    lines = spark.read.text(root).where(~F.startswith("value", F.lit("RegionID,"))).agg(F.count(F.lit(1)).alias("rows")).select(F.lit("lines").alias("reason"), "rows", none)
    kept = rows.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum("Value"), F.lit(0.0)).alias("total_value")).select(F.lit("kept").alias("reason"), "rows", "total_value")
    return kept.unionByName(lines).unionByName(spark.read.parquet(out).groupBy("reason").agg(F.count(F.lit(1)).alias("rows")).select("reason", "rows", none))


@register("clean_rejects", _dirty(
    "SELECT Dataset, count(*) AS rows_read, count(*) FILTER (WHERE d IS NULL) AS invalid_dates, "
    "count(*) FILTER (WHERE d IS NOT NULL AND (v IS NULL OR isnan(v))) AS invalid_values, "
    "count(*) FILTER (WHERE d IS NOT NULL AND v IS NOT NULL AND NOT isnan(v)) AS rows_kept "
    "FROM (SELECT *, coalesce(TRY_CAST(try_strptime(trim(Date), '%Y-%m-%d') AS DATE), "
    "TRY_CAST(try_strptime(trim(Date), '%m/%d/%Y') AS DATE)) AS d, TRY_CAST(trim(Value) AS DOUBLE) AS v FROM dirty) x "
    "GROUP BY Dataset"))
def clean_rejects(spark, sf):
    return C.clean_rejects(P.dirty_panel(spark, sf))


_NULL_RATES = ("SELECT Dataset, column_name AS \"column\", "
               + R("CAST(nulls AS DOUBLE) / CAST(_rows AS DOUBLE) * 100.0") + " AS missing_pct, "
               "CAST(nulls AS DOUBLE) / CAST(_rows AS DOUBLE) * 100.0 > 10.0 AS flagged "
               "FROM (UNPIVOT (SELECT Dataset, count(*) AS _rows, "
               + ", ".join(f"count(*) FILTER (WHERE {c} IS NULL) AS {c}" for c in O.LONG_COLS if c != "Dataset")
               + " FROM cleaned GROUP BY Dataset) ON "
               + ", ".join(c for c in O.LONG_COLS if c != "Dataset") + " INTO NAME column_name VALUE nulls) u")


@register("null_rates", _dirty(_NULL_RATES))
def null_rates(spark, sf):
    return pf.null_rates(_cleaned(spark, sf))


_IQR = ("SELECT q.Dataset, q1, q3, lower, upper, count(*) AS rows, "
        "count(*) FILTER (WHERE c.Value < lower OR c.Value > upper) AS outliers FROM cleaned c JOIN "
        "(SELECT Dataset, q1, q3, q1 - 1.5 * (q3 - q1) AS lower, q3 + 1.5 * (q3 - q1) AS upper FROM "
        "(SELECT Dataset, quantile_cont(Value, 0.25) AS q1, quantile_cont(Value, 0.75) AS q3 FROM cleaned "
        "GROUP BY Dataset) a) q ON c.Dataset = q.Dataset GROUP BY q.Dataset, q1, q3, lower, upper")


# q1/q3 of 2-decimal values have <= 4 decimals and the fences <= 5: 6 places keep
# the rounding off exact half-way points.
@register("iqr_outliers", scale=6, sql=_dirty(
    f"SELECT Dataset, {R('q1')} AS q1, {R('q3')} AS q3, {R('lower')} AS lower, {R('upper')} AS upper, rows, outliers, "
    f"{R('CAST(outliers AS DOUBLE) / CAST(rows AS DOUBLE) * 100.0')} AS outlier_pct, "
    f"CAST(outliers AS DOUBLE) / CAST(rows AS DOUBLE) * 100.0 > 5.0 AS flagged FROM ({_IQR}) z").replace(
    "* 10000.0 + 0.5) / 10000.0)", "* 1000000.0 + 0.5) / 1000000.0)"))
def iqr_outliers(spark, sf):
    return pf.iqr_outliers(_cleaned(spark, sf))


_DUP = ("SELECT Dataset, sum(c) AS rows, count(*) AS distinct_rows, sum(c - 1) AS duplicates FROM "
        "(SELECT " + ", ".join(O.LONG_COLS) + ", count(*) AS c FROM cleaned GROUP BY ALL) g GROUP BY Dataset")


@register("duplicate_rows", _dirty(
    "SELECT Dataset, CAST(rows AS BIGINT) AS rows, distinct_rows, CAST(duplicates AS BIGINT) AS duplicates, "
    f"duplicates > 0 AS flagged FROM ({_DUP}) d"))
def duplicate_rows(spark, sf):
    return pf.duplicate_rows(_cleaned(spark, sf))


_SPACING = ("SELECT Dataset, avg(g) AS avg_gap_months FROM (SELECT Dataset, RegionName, "
            "CAST(datediff('day', min(Date), max(Date)) AS DOUBLE) / 30.44 / CAST(count(*) AS DOUBLE) AS g "
            "FROM cleaned WHERE RegionName IS NOT NULL GROUP BY Dataset, RegionName) r GROUP BY Dataset")


@register("date_spacing", _dirty(
    f"SELECT Dataset, {R('avg_gap_months')} AS avg_gap_months, avg_gap_months > 2.0 AS flagged FROM ({_SPACING}) s"))
def date_spacing(spark, sf):
    return pf.date_spacing(_cleaned(spark, sf))


@register("quality_report", _dirty(
    f"SELECT Dataset, 'missing_pct:' || \"column\" AS check, missing_pct AS metric, flagged FROM ({_NULL_RATES}) a "
    f"UNION ALL SELECT Dataset, 'outlier_pct', {R('CAST(outliers AS DOUBLE) / CAST(rows AS DOUBLE) * 100.0')}, "
    f"CAST(outliers AS DOUBLE) / CAST(rows AS DOUBLE) * 100.0 > 5.0 FROM ({_IQR}) b "
    f"UNION ALL SELECT Dataset, 'duplicate_rows', CAST(duplicates AS DOUBLE), duplicates > 0 FROM ({_DUP}) c "
    f"UNION ALL SELECT Dataset, 'avg_gap_months', {R('avg_gap_months')}, avg_gap_months > 2.0 FROM ({_SPACING}) d"))
def quality_report(spark, sf):
    return pf.quality_report(_cleaned(spark, sf))


# --- JN-9, AGG-18 -------------------------------------------------------------------------------------------------

SHORT = {"home_values": "home", "rents": "rent", "inventory_metro": "inventory", "sales_count_metro": "sales"}
_WIDE_COLS = [f"{s}_{k}" for s in SHORT.values() for k in ("mean", "median", "std")]


def _wide_sql():
    parts = []
    for s in SHORT.values():
        parts.append(f"(SELECT Date, avg(Value) AS {s}_mean, median(Value) AS {s}_median, stddev_samp(Value) AS {s}_std "
                     f"FROM {s} WHERE Date IS NOT NULL GROUP BY Date) {s}_m")
    sql = parts[0]
    for p in parts[1:]:
        sql += f" FULL OUTER JOIN {p} USING (Date)"
    return f"SELECT Date, {', '.join(_WIDE_COLS)} FROM {sql}"


@register("monthly_wide", O.with_panels(
    f"SELECT Date, {', '.join(R(c) + ' AS ' + c for c in _WIDE_COLS)} FROM ({_wide_sql()}) w", *ALL4))
def monthly_wide(spark, sf):
    return pf.monthly_wide(_stack_shared(spark, sf), SHORT)


@register("metric_correlations", O.with_panels(
    f"SELECT metric_a, metric_b, {R('correlation')} AS correlation FROM ("
    + " UNION ALL ".join(f"SELECT '{a}' AS metric_a, '{b}' AS metric_b, corr({a}, {b}) AS correlation FROM w"
                         for a, b in combinations(_WIDE_COLS, 2))
    + ") c WHERE abs(correlation) > 0.7", *ALL4).replace("\nSELECT metric_a", f", w AS ({_wide_sql()})\nSELECT metric_a", 1))
def metric_correlations(spark, sf):
    return pf.metric_correlations(pf.monthly_wide(_stack_shared(spark, sf), SHORT))
