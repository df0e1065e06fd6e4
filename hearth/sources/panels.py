"""Long panels derived from the driver tables (the stand-ins for the four monthly
regional series), plus the dirty panel, the scoring-request table and the request log.

Every panel but sales is pre-aggregated on lineitem *before* it is joined to supplier, so
the join sees suppliers x months rows instead of lineitem rows, and the
aggregation's map-side combine absorbs a supplier holding a third of lineitem. Sales counts distinct
orders, which no partial sum by supplier gives; its lines meet a written two-column supplier table.
nation (25 rows) and region (5 rows) are fixed-size and broadcast explicitly;
the supplier side grows with the data and is left to AQE's runtime size check.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearth.functions.exprs import round_half_up
from hearth.session import materialize
from hearth.sources.tables import read_table

# Fixed derivation parameters of the driver-table panels.
DATASET_NAMES = {"home": "home_values", "rent": "rents", "inventory": "inventory_metro", "sales": "sales_count_metro"}


def _month(ts_col: str) -> F.Column:
    return F.date_trunc("month", F.col(ts_col)).cast("date")


def _geo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """nation x region, both fixed-size dimension tables (broadcast)."""
    nation = read_table(spark, sf_dir, "nation", ["n_nationkey", "n_name", "n_regionkey"])
    region = read_table(spark, sf_dir, "region", ["r_regionkey", "r_name"])
    return nation.join(F.broadcast(region), nation.n_regionkey == region.r_regionkey).select(
        "n_nationkey", "n_name", "r_name")


def _supplier_geo(spark: SparkSession, sf_dir: str) -> DataFrame:
    supplier = read_table(spark, sf_dir, "supplier", ["s_suppkey", "s_name", "s_nationkey"])
    geo = _geo(spark, sf_dir)
    return supplier.join(F.broadcast(geo), supplier.s_nationkey == geo.n_nationkey).select(
        "s_suppkey", "s_name", "s_nationkey", "n_name", "r_name")


def _supplier_panel(agg: DataFrame, spark: SparkSession, sf_dir: str, dataset: str) -> DataFrame:
    sg = _supplier_geo(spark, sf_dir)
    return _supplier_rows(agg.join(sg, agg.l_suppkey == sg.s_suppkey), dataset)


def _cents() -> list[F.Column]:
    """What the home value is made of: integer cents and lines."""
    return [F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).alias("_cents"), F.count(F.lit(1)).alias("_n")]


def _home_value() -> F.Column:
    """Mean price from integer cents: one correctly rounded division."""
    return F.col("_cents").cast("double") / (F.lit(100.0) * F.col("_n").cast("double"))


def _unit_prices() -> list[F.Column]:
    """What the rent value is made of: the unit prices' sum and count."""
    unit = F.try_divide("l_extendedprice", "l_quantity")
    return [F.sum(unit).alias("_unit_sum"), F.count(unit).alias("_unit_n")]


def _rent_value() -> F.Column:
    """Mean unit price / 12."""
    return F.try_divide(F.col("_unit_sum"), F.col("_unit_n").cast("double")) / F.lit(12.0)


def home_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """supplier x month, Value = mean extended price, computed in integer cents so
    the mean is one correctly rounded division (bit-identical across engines)."""
    li = read_table(spark, sf_dir, "lineitem", ["l_suppkey", "l_shipdate", "l_extendedprice"])
    agg = li.groupBy("l_suppkey", _month("l_shipdate").alias("Date")).agg(*_cents()).select(
        "l_suppkey", "Date", _home_value().alias("Value"))
    return _supplier_panel(agg, spark, sf_dir, "home")


def rent_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """supplier x month, Value = mean unit price / 12."""
    li = read_table(spark, sf_dir, "lineitem", ["l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity"])
    agg = li.groupBy("l_suppkey", _month("l_shipdate").alias("Date")).agg(*_unit_prices()).select(
        "l_suppkey", "Date", _rent_value().alias("Value"))
    return _supplier_panel(agg, spark, sf_dir, "rent")


def _nation_panel(agg: DataFrame, spark: SparkSession, sf_dir: str, dataset: str) -> DataFrame:
    geo = _geo(spark, sf_dir)
    j = agg.join(F.broadcast(geo), agg.s_nationkey == geo.n_nationkey)
    return j.select(
        F.col("n_nationkey").cast("long").alias("RegionID"),
        F.col("n_nationkey").cast("int").alias("SizeRank"),
        F.col("n_name").alias("RegionName"),
        F.lit("msa").alias("RegionType"),
        F.col("r_name").alias("StateName"),
        F.substring("r_name", 1, 2).alias("State"),
        F.col("n_name").alias("Metro"),
        F.lit(None).cast("string").alias("CountyName"),
        F.col("Date"),
        F.col("Value").cast("double").alias("Value"),
        F.lit(DATASET_NAMES[dataset]).alias("Dataset"),
        F.lit("metro").alias("GeographyLevel"),
    )


def inventory_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """nation x month, Value = total quantity. Pre-aggregated per supplier first."""
    li = read_table(spark, sf_dir, "lineitem", ["l_suppkey", "l_shipdate", "l_quantity"])
    per_supp = li.groupBy("l_suppkey", _month("l_shipdate").alias("Date")).agg(F.sum("l_quantity").alias("_q"))
    supp = read_table(spark, sf_dir, "supplier", ["s_suppkey", "s_nationkey"])
    agg = per_supp.join(supp, per_supp.l_suppkey == supp.s_suppkey).groupBy("s_nationkey", "Date").agg(
        F.sum("_q").alias("Value"))
    return _nation_panel(agg, spark, sf_dir, "inventory")


def sales_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """nation x month, Value = distinct orders. The lines meet (supplier, nation), written first,
    so its size is known when the join is planned: under the broadcast limit no line moves,
    beyond it the join's skew handling splits a hot supplier. Then one distinct per (nation,
    month, order), combined before it moves, spreads the rows by order."""
    li = read_table(spark, sf_dir, "lineitem", ["l_suppkey", "l_shipdate", "l_orderkey"])
    supp = materialize(read_table(spark, sf_dir, "supplier", ["s_suppkey", "s_nationkey"]), "supplier-nation")
    lines = li.join(supp, li.l_suppkey == supp.s_suppkey).select("s_nationkey", _month("l_shipdate").alias("Date"), "l_orderkey")
    agg = lines.distinct().groupBy("s_nationkey", "Date").agg(F.count("l_orderkey").cast("double").alias("Value"))
    return _nation_panel(agg, spark, sf_dir, "sales")


PANELS = {"home": home_panel, "rent": rent_panel, "inventory": inventory_panel, "sales": sales_panel}


def panel(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return PANELS[name](spark, sf_dir)


def dirty_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The home panel as text, with deterministic defects (FIXTURES.md section 2):
    unparseable dates, unparseable values, full duplicate rows and x100 outliers."""
    home = home_panel(spark, sf_dir)
    rid = F.col("RegionID")
    m = F.month("Date")
    value = F.when((rid % 19) == 0, F.col("Value") * 100).otherwise(F.col("Value"))
    value_txt = F.when(((rid % 11) == 0) & (m == 6), F.lit("n/a")).otherwise(
        round_half_up(value, 2).cast("string"))
    date_txt = F.when(((rid % 13) == 0) & (m == 1), F.lit("not-a-date")).otherwise(
        F.date_format("Date", "yyyy-MM-dd"))
    txt = home.select(
        "RegionID", "SizeRank", "RegionName", "RegionType", "StateName", "State", "Metro", "CountyName",
        date_txt.alias("Date"), value_txt.alias("Value"), "Dataset", "GeographyLevel")
    dup = txt.where(((F.col("RegionID") % 7) == 0) & (F.substring("Date", 6, 2) == "03"))
    return txt.unionByName(dup)


# Fixed derivation of the scoring-request table from customer (FIXTURES.md section 2).
SEGMENT_PROPERTY_TYPES = (("AUTOMOBILE", "SingleFamily"), ("BUILDING", "Condo"), ("FURNITURE", "Townhouse"),
                          ("HOUSEHOLD", "MultiFamily"))
UNKNOWN_PROPERTY_TYPE = "Mobile"


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valuation requests, one per customer, with deterministic defects: 4-digit
    ZIPs, lower-case and unknown states, low or negative values, missing rents."""
    c = read_table(spark, sf_dir, "customer", ["c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment"])
    return requests_from_customer(c, region_count(spark, sf_dir))


def region_count(spark: SparkSession, sf_dir: str) -> int:
    """The largest region number (regions are supplier keys)."""
    return int(read_table(spark, sf_dir, "supplier", ["s_suppkey"]).agg(F.max("s_suppkey")).first()[0] or 1)


def requests_from_customer(c: DataFrame, n_regions: int) -> DataFrame:
    """Row-wise derivation, so it applies to a batch or a streaming customer frame.
    ``region`` names the region that the request asks about."""
    from hearth.operators.scoring import US_STATES
    key = F.col("c_custkey")
    zip5 = F.lpad((key % 100000).cast("string"), 5, "0")
    state = F.col("c_nationkey") % 25 + F.lit(25) * (key % 2)  # all 50
    code = F.element_at(F.array(*[F.lit(s) for s in US_STATES]), (state + 1).cast("int"))
    value = F.col("c_acctbal") * F.lit(250)
    ptype = F.coalesce(*[F.when(F.col("c_mktsegment") == s, F.lit(t)) for s, t in SEGMENT_PROPERTY_TYPES],
                       F.lit(UNKNOWN_PROPERTY_TYPE))
    return c.select(
        key.alias("request_id"),
        (key % n_regions + 1).cast("string").alias("region"),
        F.when(key % 17 == 0, F.substring(zip5, 2, 4)).otherwise(zip5).alias("zip_code"),
        F.when(key % 23 == 0, F.lit("ZZ")).when(key % 5 == 0, F.lower(code)).otherwise(code).alias("state"),
        value.cast("double").alias("current_value"),
        ptype.alias("property_type"),
        F.when(key % 3 == 0, F.lit(None).cast("double")).otherwise(
            value / (F.lit(12) * (F.lit(5) + key % 30))).cast("double").alias("recent_rent"),
    )


def dated_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests that ask about a region as of a day of their own, one per order."""
    o = read_table(spark, sf_dir, "orders", ["o_orderkey", "o_custkey", "o_orderdate"])
    n = region_count(spark, sf_dir)
    return o.select(F.col("o_orderkey").alias("request_id"), (F.col("o_custkey") % n + 1).cast("string").alias("region"),
                    F.col("o_orderdate").cast("date").alias("as_of"))


def request_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The service's request log from events: ts as a UTC timestamp, client,
    kind (purchase = prediction, error = error, rest = other)."""
    e = read_table(spark, sf_dir, "events", ["event_id", "ts", "user_id", "event_type"])
    return request_log_from_events(e)


def request_log_from_events(e: DataFrame) -> DataFrame:
    """Row-wise, so it applies to a batch or a streaming events frame."""
    return e.select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("client"),
                    F.when(F.col("event_type") == "purchase", F.lit("prediction"))
                    .when(F.col("event_type") == "error", F.lit("error")).otherwise(F.lit("other")).alias("kind"))


def supplier_month_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One lineitem pass for the home, rent and inventory panels: per (supplier,
    month) the integer-cent sum and line count (home), the unit-price sum and
    count from the rent start on (rent), and the quantity sum (inventory), joined
    to the supplier's geography once."""
    li = read_table(spark, sf_dir, "lineitem", ["l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity"])
    agg = li.groupBy("l_suppkey", _month("l_shipdate").alias("Date")).agg(*_cents(), *_unit_prices(), F.sum("l_quantity").alias("_q"))
    sg = _supplier_geo(spark, sf_dir)
    return agg.join(sg, agg.l_suppkey == sg.s_suppkey).drop("l_suppkey")


def home_from_facts(facts: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    return _supplier_rows(facts.withColumn("Value", _home_value()), "home")


def rent_from_facts(facts: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    return _supplier_rows(facts.withColumn("Value", _rent_value()), "rent")


def inventory_from_facts(facts: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    agg = facts.groupBy("s_nationkey", "Date").agg(F.sum("_q").alias("Value"))
    return _nation_panel(agg, spark, sf_dir, "inventory")


#: Panels that ``supplier_month_facts`` gives.
FROM_FACTS = {"home": home_from_facts, "rent": rent_from_facts, "inventory": inventory_from_facts}


def _supplier_rows(j: DataFrame, dataset: str) -> DataFrame:
    return j.select(
        F.col("s_suppkey").cast("long").alias("RegionID"),
        F.col("s_suppkey").cast("int").alias("SizeRank"),
        F.col("s_suppkey").cast("string").alias("RegionName"),
        F.lit("zip").alias("RegionType"),
        F.col("r_name").alias("StateName"),
        F.substring("r_name", 1, 2).alias("State"),
        F.col("n_name").alias("Metro"),
        F.col("s_name").alias("CountyName"),
        F.col("Date"),
        F.col("Value").cast("double").alias("Value"),
        F.lit(DATASET_NAMES[dataset]).alias("Dataset"),
        F.lit("zip").alias("GeographyLevel"),
    )
