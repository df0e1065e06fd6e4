"""Registered queries: wide-file ingest, reshape, schema discovery and sinks
(SURVEY 2.1 SRC-2/3/5/6, 2.2 RSH-1/4/5). Files are written under the shared
checkpoint folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from hearth.plans import oracle as O
from hearth.plans.features import feature_table
from hearth.plans.queries_profile import ALL4, DIRTY, _all, _stack
from hearth.plans.queries_training import CATALOGUE, TRAIN_WHERE
from hearth.plans.queries_market import feature_table_sql
from hearth.plans.registry import register
from hearth.schema import DatasetRegistry
from hearth.session import scratch_path
from hearth.sources import panels as P
from hearth.sources import wide as Wd
from hearth.operators import targets as tg
from hearth.operators import training as tr

R = O.rnd
REG = DatasetRegistry()
_LONG_SEL = ", ".join(R(c) + " AS Value" if c == "Value" else c for c in O.LONG_COLS)


@register("wide_to_long", O.with_panels(f"SELECT {_LONG_SEL} FROM home", "home"))
def wide_to_long(spark, sf):
    home = P.home_panel(spark, sf)
    return Wd.wide_to_long(Wd.long_to_wide(home), REG.get(P.DATASET_NAMES["home"])).select(*O.LONG_COLS)


@register("ingest_wide_csv", O.with_panels(f"SELECT {_LONG_SEL} FROM home", "home"))
def ingest_wide_csv(spark, sf):
    info = REG.get(P.DATASET_NAMES["home"])
    root = scratch_path(spark, "wide")
    Wd.write_wide_csv(P.home_panel(spark, sf), f"{root}/{info.file_path}")
    return Wd.ingest_wide_csv(spark, root, info).select(*O.LONG_COLS)


@register("ingest_all", _all(f"SELECT {_LONG_SEL} FROM allp"))
def ingest_all(spark, sf):
    root = scratch_path(spark, "wide-all")
    for short in ALL4:
        info = REG.get(P.DATASET_NAMES[short])
        Wd.write_wide_csv(P.panel(spark, sf, short), f"{root}/{info.file_path}")
    return Wd.ingest_all(spark, root, REG).select(*O.LONG_COLS)


@register("detect_date_columns", O.with_panels(
    f",{DIRTY}\nSELECT column_name, first_value, coalesce((((instr(first_value, '-') > 0 AND length(first_value) = 10) "
    "OR instr(first_value, '/') > 0) AND coalesce(TRY_CAST(try_strptime(trim(first_value), '%Y-%m-%d') AS DATE), "
    "TRY_CAST(try_strptime(trim(first_value), '%m/%d/%Y') AS DATE)) IS NOT NULL), false) AS is_date FROM (UNPIVOT "
    "(SELECT " + ", ".join(
        f"arg_min(CAST({c} AS VARCHAR), lpad(CAST(RegionID AS VARCHAR), 20, '0') || '|' || coalesce(Date, '')) "
        f"FILTER (WHERE {c} IS NOT NULL) AS {c}" for c in ("Date", "Value", "Dataset", "GeographyLevel"))
    + " FROM dirty) ON Date, Value, Dataset, GeographyLevel INTO NAME column_name VALUE first_value) u", "home"))
def detect_date_columns(spark, sf):
    return Wd.detect_date_columns(P.dirty_panel(spark, sf))


@register("detect_value_columns", O.with_panels(
    "SELECT m AS column_name, CAST(row_number() OVER (ORDER BY m) - 1 AS INTEGER) AS position, true AS numeric, "
    "row_number() OVER (ORDER BY m) = 1 AS is_value_column FROM (SELECT DISTINCT strftime(Date, '%Y-%m-%d') AS m "
    "FROM home) d", "home"))
def detect_value_columns(spark, sf):
    root = scratch_path(spark, "wide-detect")
    Wd.write_wide_csv(P.home_panel(spark, sf), root)
    wide = Wd.read_wide_csv(spark, root)
    return Wd.detect_value_columns(wide).withColumn("position", F.col("position").cast("int"))


@register("save_long", _all(f"SELECT {_LONG_SEL} FROM allp"))
def save_long(spark, sf):
    path = Wd.save_long(_stack(spark, sf), scratch_path(spark, "long"))
    return spark.read.parquet(path).select(*O.LONG_COLS)


@register("save_features", "WITH ft AS (" + feature_table_sql(rounded=False) + ")\n"
          "SELECT 'complete' AS output, count(*) AS rows FROM ft UNION ALL "
          f"SELECT 'training', count(*) FROM ft {TRAIN_WHERE} UNION ALL "
          f"SELECT 'feature_summary', CAST({len(CATALOGUE)} AS BIGINT)")
def save_features(spark, sf):
    """SRC-6: complete table, training rows and the catalogue, written and read back."""
    root = scratch_path(spark, "features")
    paths = Wd.save_tables({"complete": feature_table(spark, sf, with_clusters=False)}, root)
    complete = spark.read.parquet(paths["complete"])  # the chain runs once; the others read its result
    paths |= Wd.save_tables({"training": tg.training_rows(complete), "feature_summary": tr.feature_catalogue(complete)}, root)
    out = None
    for name, path in paths.items():
        t = spark.read.parquet(path).agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("output"), "rows")
        out = t if out is None else out.unionByName(t)
    return out
