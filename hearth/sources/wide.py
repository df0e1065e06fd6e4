"""Wide files (one column per month) to the long panel, schema discovery, and
the sinks (SRC-2/3/5/6, RSH-1..5).

Reading is ``spark.read.csv`` with every column as text (no inference: ZIP-like
names keep their leading zeros); the reshape is ``DataFrame.unpivot`` -- a
narrow Expand, no shuffle -- followed by ``try_`` casts.
"""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearth.schema import GEOGRAPHY_COLUMNS, LONG_SCHEMA, DatasetInfo, DatasetRegistry
from hearth.sources.clean import parse_date, parse_double

_ISO = re.compile(r"^\d{4}-\d{1,2}-\d{1,2}$")
_US = re.compile(r"^\d{1,2}/\d{1,2}/\d{4}$")


def geography_columns(columns: Sequence[str]) -> list[str]:
    """RSH-2: geography columns by case-insensitive name."""
    names = {g.lower() for g in GEOGRAPHY_COLUMNS}
    return [c for c in columns if c.lower() in names]


def header_date(name: str) -> dt.date | None:
    """A column header that is a date (ISO or M/D/YYYY)."""
    try:
        if _ISO.match(name):
            return dt.date.fromisoformat("-".join(p.zfill(2) for p in name.split("-")))
        if _US.match(name):
            m, d, y = (int(p) for p in name.split("/"))
            return dt.date(y, m, d)
    except ValueError:
        return None
    return None


def month_columns(columns: Sequence[str]) -> list[str]:
    """RSH-3: non-geography columns whose header parses as a date; the rest are skipped."""
    geo = set(geography_columns(columns))
    return [c for c in columns if c not in geo and header_date(c) is not None]


def wide_to_long(df: DataFrame, info: DatasetInfo) -> DataFrame:
    """RSH-1: melt month columns to (Date, Value), tag dataset and level, drop
    NULL values; geography columns conform to the long schema."""
    geo = geography_columns(df.columns)
    months = month_columns(df.columns)
    canon = {g.lower(): g for g in GEOGRAPHY_COLUMNS}
    if not months:
        return df.sparkSession.createDataFrame([], LONG_SCHEMA)
    vals = df.select(*geo, *[F.col(f"`{m}`").cast("string").alias(m) for m in months])
    long = vals.unpivot(geo, months, "_hdr", "_val")
    types = {f.name: f.dataType for f in LONG_SCHEMA.fields}
    cols = []
    for name in GEOGRAPHY_COLUMNS:
        src = next((g for g in geo if canon[g.lower()] == name), None)
        c = F.col(f"`{src}`").cast("string").try_cast(types[name]) if src else F.lit(None).cast(types[name])
        cols.append(c.alias(name))
    # the date that header_date found, not the header's text parsed once more
    dates = F.create_map(*[x for m in months for x in (F.lit(m), F.lit(header_date(m)))])
    out = long.select(*cols, dates[F.col("_hdr")].alias("Date"), parse_double("_val").alias("Value"),
                      F.lit(info.name).alias("Dataset"), F.lit(info.geography_level).alias("GeographyLevel"))
    return out.where(F.col("Value").isNotNull() & ~F.isnan("Value"))


def read_wide_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).option("inferSchema", False).csv(path)


def ingest_wide_csv(spark: SparkSession, data_dir: str, info: DatasetInfo | None) -> DataFrame | None:
    """SRC-2: one registered dataset; unregistered or missing -> None. Any other read
    error (permissions, storage, a damaged file) is raised."""
    if info is None:
        return None
    path = f"{data_dir.rstrip('/')}/{info.file_path}"
    try:
        df = read_wide_csv(spark, path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return wide_to_long(df, info)


def ingest_all(spark: SparkSession, data_dir: str, registry: DatasetRegistry | None = None) -> DataFrame:
    """SRC-3: every registered dataset that loads, stacked."""
    registry = registry or DatasetRegistry()
    out = None
    for name in registry.names():
        long = ingest_wide_csv(spark, data_dir, registry.get(name))
        if long is not None:
            out = long if out is None else out.unionByName(long)
    return out if out is not None else spark.createDataFrame([], LONG_SCHEMA)


def long_to_wide(panel: DataFrame) -> DataFrame:
    """The inverse shape: one row per region, one column per month (YYYY-MM-DD).
    The month list is the panel's distinct months -- bounded by the calendar."""
    geo = geography_columns(panel.columns)
    d = F.date_format("Date", "yyyy-MM-dd")
    months = sorted(r[0] for r in panel.select(d.alias("m")).distinct().collect())
    return panel.withColumn("_m", d).groupBy(*geo).pivot("_m", months).agg(F.first("Value"))


def write_wide_csv(panel: DataFrame, path: str) -> str:
    long_to_wide(panel).write.mode("overwrite").option("header", True).csv(path)
    return path


def detect_date_columns(df: DataFrame, order: Sequence[str] = ("RegionID", "Date")) -> DataFrame:
    """RSH-4: per non-geography column, its first non-NULL value in a stable row
    order, and whether it looks like a date (has '-' and length 10, or has '/')
    and parses. One aggregate pass."""
    geo = {g.lower() for g in GEOGRAPHY_COLUMNS}
    cands = [c for c in df.columns if c.lower() not in geo]
    key = F.concat(F.lpad(F.col(order[0]).cast("string"), 20, "0"), F.lit("|"),
                   F.coalesce(F.col(order[1]).cast("string"), F.lit("")))
    firsts = df.agg(*[F.min_by(F.col(c).cast("string"), F.when(F.col(c).isNotNull(), key)).alias(c) for c in cands])
    long = firsts.unpivot([], cands, "column_name", "first_value")
    v = F.col("first_value")
    looks = (F.instr(v, "-") > 0) & (F.length(v) == 10) | (F.instr(v, "/") > 0)
    return long.withColumn("is_date", F.coalesce(looks & parse_date(v).isNotNull(), F.lit(False)))


def detect_value_columns(df: DataFrame, exclude: Sequence[str] = ()) -> DataFrame:
    """RSH-5: non-geography, non-excluded columns whose every non-NULL value is a
    number; the first such column is the value column (metadata only)."""
    geo = {g.lower() for g in GEOGRAPHY_COLUMNS}
    cands = [c for c in df.columns if c.lower() not in geo and c not in exclude]
    agg = df.agg(*[(F.count(F.col(f"`{c}`")) == F.count(parse_double(F.col(f"`{c}`")))).alias(f"c{i}")
                   for i, c in enumerate(cands)])
    stack = ", ".join(f"'{c}', {i}, c{i}" for i, c in enumerate(cands))
    long = agg.selectExpr(f"stack({len(cands)}, {stack}) as (column_name, position, numeric)")
    first = long.where("numeric").select(F.min("position")).scalar()
    return long.withColumn("is_value_column", F.coalesce(F.col("position") == first, F.lit(False)))


def save_long(df: DataFrame, path: str) -> str:
    """SRC-5: the long panels, one folder per dataset."""
    df.write.mode("overwrite").partitionBy("Dataset").parquet(path)
    return path


def save_tables(tables: dict[str, DataFrame], root: str) -> dict[str, str]:
    """SRC-6: each named table as Parquet under ``root``."""
    out = {}
    for name, df in tables.items():
        path = f"{root.rstrip('/')}/{name}"
        df.write.mode("overwrite").parquet(path)
        out[name] = path
    return out
