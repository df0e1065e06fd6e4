"""Text long panels -> typed long panels (SRC-4, RSH-6..10).

Bad dates and bad values become NULL through ``try_`` casts (Spark 4 runs in
ANSI mode, where a plain cast would fail the job) and the rows are dropped, as
the reference's loaders do.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearth.schema import LONG_SCHEMA
from hearth.session import materialize

REQUIRED = ("Date", "Value")


def parse_date(c: str | Column) -> Column:
    """ISO ``yyyy-MM-dd`` first, then ``M/d/yyyy``; anything else is NULL."""
    c = F.col(c) if isinstance(c, str) else c
    s = F.trim(c.cast("string"))
    return F.coalesce(F.try_to_date(s, "yyyy-MM-dd"), F.try_to_date(s, "M/d/yyyy"))


def parse_double(c: str | Column) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.trim(c.cast("string")).try_cast("double")


def missing_required(df: DataFrame, required=REQUIRED) -> list[str]:
    """RSH-9: required columns that are absent."""
    return [c for c in required if c not in df.columns]


def clean_long(df: DataFrame) -> DataFrame:
    """SRC-4: coerce Date and Value, drop rows where either is invalid, drop all-null rows."""
    miss = missing_required(df)
    if miss:
        raise ValueError(f"missing required columns: {miss}")
    out = df.withColumn("Date", parse_date("Date")).where(F.col("Date").isNotNull())
    out = out.withColumn("Value", parse_double("Value")).where(F.col("Value").isNotNull() & ~F.isnan("Value"))
    return out.dropna(how="all")


def read_long_csv(spark: SparkSession, path: str) -> DataFrame | None:
    """SRC-4: one long CSV (header, every column as text), cleaned. A missing file, or one
    without a required column, gives None, as the reference skips that dataset; any other
    error is raised."""
    try:
        raw = spark.read.option("header", True).option("inferSchema", False).csv(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return None if missing_required(raw) else clean_long(raw)


CORRUPT = "_corrupt"


def read_quarantined(spark: SparkSession, path: str, schema: T.StructType = LONG_SCHEMA) -> tuple[DataFrame, DataFrame]:
    """SRC-4, RSH-7/8 without a loss: one long CSV (header, columns in the order of ``schema``) read with its
    types, and what does not fit kept: (rows, rejects). A line that the typed read refuses is read once more as
    text, so a date in the second format counts; the others are rejects(line, reason), where reason names what
    is wrong: date, value, fields (their number, or another column's type). Rows and rejects are all lines."""
    names = schema.fieldNames()
    read = spark.read.schema(T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())]))
    options = {"header": "true", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT, "dateFormat": "yyyy-MM-dd"}
    # written once: rows and rejects both read it, and Spark answers nothing from the corrupt column alone
    lines = materialize(read.options(**options).csv(path), "lines")
    text = T.StructType([T.StructField(n, T.StringType()) for n in names]).add(CORRUPT, "string")
    again = F.from_csv(F.col(CORRUPT), F.lit(", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in text)), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    raw = lines.where(F.col(CORRUPT).isNotNull()).select(F.col(CORRUPT).alias("line"), again.alias("t"))
    parsed = {f.name: F.trim(F.col(f"t.{f.name}")).try_cast(f.dataType) for f in schema if f.name != CORRUPT}
    parsed |= {"Date": parse_date(F.col("t.Date")), "Value": parse_double(F.col("t.Value"))}
    misfit = F.col(f"t.{CORRUPT}").isNotNull()
    for n, c in parsed.items():
        if n not in REQUIRED:
            misfit = misfit | (F.col(f"t.{n}").isNotNull() & c.isNull())
    second = raw.select("line", misfit.alias("misfit"), *[c.alias(n) for n, c in parsed.items()])
    first = lines.where(F.col(CORRUPT).isNull()).select(F.to_csv(F.struct(*names)).alias("line"), F.lit(False).alias("misfit"), *names)
    both = first.unionByName(second)
    bad_value = F.col("Value").isNull() | F.isnan("Value")
    reason = F.concat_ws(", ", F.when(F.col("Date").isNull(), "date"), F.when(bad_value, "value"), F.when(F.col("misfit"), "fields"))
    both = both.withColumn("reason", reason)
    return both.where("reason = ''").select(*names), both.where("reason <> ''").select("line", "reason")


def load_long(spark: SparkSession, paths: dict[str, str]) -> dict[str, DataFrame]:
    """The long CSVs that load, by name."""
    found = {name: read_long_csv(spark, path) for name, path in paths.items()}
    return {name: df for name, df in found.items() if df is not None}


def clean_rejects(df: DataFrame, by: str = "Dataset") -> DataFrame:
    """RSH-6: per dataset, rows read, rows with an invalid date, rows (with a valid
    date) whose value is invalid, rows kept -- one pass."""
    d = parse_date("Date")
    v = parse_double("Value")
    bad_date = d.isNull()
    bad_value = d.isNotNull() & (v.isNull() | F.isnan(v))
    return df.groupBy(by).agg(
        F.count(F.lit(1)).alias("rows_read"),
        F.count_if(bad_date).alias("invalid_dates"),
        F.count_if(bad_value).alias("invalid_values"),
        F.count_if(~bad_date & ~bad_value).alias("rows_kept"),
    )
