"""Training-set preparation (PRJ-14, ENC-1, TRN-2, TRN-3, SCL-1).

The ordered split needs every row's position in the global (Date, RegionName)
order. A window without a partition key would pull the whole table into one
task; instead positions come from ``prefix_counts`` (range partitioning + a
small offset table). Label codes are ranks among a column's distinct values,
computed the same way, so a column with a billion distinct values is still
spread over all tasks.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearth.operators.order_stats import prefix_counts
from hearth.schema import METADATA_COLUMNS
from hearth.session import materialize, together

# Fixed values of the reference's split.
TEST_SIZE = 0.2
VAL_SIZE = 0.15
TARGETS = ("target_return_1m", "target_return_3m", "target_return_6m", "target_return_12m")

# Range partitions of the value counts among which a cut of the split is looked up.
CUT_PARTITIONS = 8

# Column-name substrings of the feature catalogue, first match wins.
CATALOGUE_RULES = (
    ("temporal", ("lag", "rolling", "trend", "pct_change")),
    ("geographic", ("State", "Metro", "Cluster")),
    ("market_dynamics", ("Ratio", "Supply", "National")),
    ("time", ("Year", "Month", "Quarter")),
)


#: Name of the row over all types.
TOTAL = "total"


def catalogue_type(name: str) -> str:
    for kind, subs in CATALOGUE_RULES:
        if any(s in name for s in subs):
            return kind
    return "other"


def catalogue_columns(columns: Sequence[str]) -> list[str]:
    """Feature columns of the catalogue: everything but the six metadata names
    (target columns stay in, as in the reference)."""
    return [c for c in columns if c not in METADATA_COLUMNS]


def feature_catalogue(df: DataFrame) -> DataFrame:
    """PRJ-14: (Feature, Type, position, non_null) -- the type rule applied to the
    column names, with the non-null count of each column from one pass."""
    cols = catalogue_columns(df.columns)
    counts = df.agg(*[F.count(F.col(f"`{c}`")).alias(f"n{i}") for i, c in enumerate(cols)])
    stack = ", ".join(f"'{c}', '{catalogue_type(c)}', {i}, n{i}" for i, c in enumerate(cols))
    return counts.selectExpr(f"stack({len(cols)}, {stack}) as (Feature, Type, position, non_null)")


def feature_type_counts(catalogue: DataFrame) -> DataFrame:
    """PRJ-14: features and their non-null cells per type, and of all types (``TOTAL``), in one pass of
    grouping sets over the catalogue."""
    both = catalogue.rollup("Type").agg(F.count(F.lit(1)).alias("features"), F.sum("non_null").alias("non_null"), F.grouping_id().alias("_all"))
    return both.select(F.when(F.col("_all") == 1, F.lit(TOTAL)).otherwise(F.col("Type")).alias("Type"), "features", "non_null")


def model_feature_columns(df: DataFrame) -> list[str]:
    """TRN-3: features = all columns but metadata and target_*."""
    return [c for c in df.columns if c not in METADATA_COLUMNS and not c.startswith("target_")]


def categorical_columns(df: DataFrame, cols: Sequence[str]) -> list[str]:
    types = dict(df.dtypes)
    return [c for c in cols if types[c] == "string"]


def label_codes(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """ENC-1: (column_name, value, code) -- each column's distinct values as text
    (NULL -> 'nan'), sorted, numbered from 0. Ranks of distinct values come from
    prefix counts grouped by column, so no column is numbered in one task."""
    out = None
    for c in cols:
        d = df.select(F.lit(c).alias("column_name"), F.coalesce(F.col(c).cast("string"), F.lit("nan")).alias("value"))
        out = d if out is None else out.unionByName(d)
    distinct = out.distinct()
    pc = prefix_counts(distinct, ["column_name"], ["value"])
    # written once: every encoded column reads its part of this table
    return materialize(pc.select("column_name", "value", F.col("_before").cast("int").alias("code")), "codes")


def label_encode(df: DataFrame, cols: Sequence[str], codes: DataFrame | None = None) -> DataFrame:
    """Replace each string column by its code (codes fitted on ``df`` unless given)."""
    codes = codes if codes is not None else label_codes(df, cols)
    out = df
    for c in cols:
        m = codes.where(F.col("column_name") == c).select(F.col("value").alias(f"_v_{c}"), F.col("code").alias(f"_c_{c}"))
        out = out.withColumn(f"_k_{c}", F.coalesce(F.col(c).cast("string"), F.lit("nan")))
        out = out.join(m, out[f"_k_{c}"] == m[f"_v_{c}"], "left").withColumn(c, F.col(f"_c_{c}")).drop(
            f"_k_{c}", f"_v_{c}", f"_c_{c}")
    return out


def with_positions(df: DataFrame, order: Sequence[str] = ("Date", "RegionName"), out: str = "position") -> DataFrame:
    """WIN-11: 0-based position of each row in the global order, plus ``_n`` rows.

    The rows themselves are ranked, so NULL keys (first) and repeated keys keep their
    rows and every row gets a position of its own; rows of one key follow in the order
    of a hash of their columns, which also spreads a very frequent key."""
    tied = df.withColumn("_tie", F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]))
    pc = prefix_counts(tied, [], [*order, "_tie"])
    return pc.withColumnsRenamed({"_before": out, "_total": "_n"}).drop("_tie")


def ordered_split(df: DataFrame, test_size: float = TEST_SIZE, val_size: float = VAL_SIZE,
                  order: Sequence[str] = ("Date", "RegionName")) -> DataFrame:
    """TRN-2: positional train/val/test labels: test from int(n(1-test)), val from
    int(test_start(1-val)); order by Date with RegionName breaking ties."""
    p = with_positions(df, order)
    test_start = F.floor(F.col("_n").cast("double") * F.lit(1.0 - test_size))
    val_start = F.floor(test_start.cast("double") * F.lit(1.0 - val_size))
    split = F.when(F.col("position") < val_start, F.lit("train")).when(
        F.col("position") < test_start, F.lit("val")).otherwise(F.lit("test"))
    return p.withColumn("split", split).drop("_n")


def _row_at(df: DataFrame, order: Sequence[str], position: int) -> tuple[list, int]:
    """(values of the first ``order`` columns of the row at ``position`` of the ascending order, rows equal to
    it in them that come before it). Column by column: the counts of a column's values tell which of them the
    row has, and only rows with that value are looked at for the next column; no row moves."""
    rows, key = df, []
    for c in order:
        counts = prefix_counts(rows.groupBy(c).agg(F.count(F.lit(1)).alias("_n")), [], [c], "_n", num_partitions=CUT_PARTITIONS)
        at = counts.where((F.col("_before") <= position) & (F.lit(position) < F.col("_before") + F.col("_n"))).first()
        key.append(at[c])
        position -= at["_before"]
        if at["_n"] == 1:
            break
        rows = rows.where(F.col(c).eqNullSafe(F.lit(at[c])))
    return key, position


def _comes_before(order: Sequence[str], key: Sequence) -> Column:
    """Whether a row sorts before ``key`` (ascending, NULL first)."""
    def step(rest: Column, part: tuple) -> Column:
        c, v = F.col(part[0]), part[1]
        less = F.lit(False) if v is None else c.isNull() | (c < F.lit(v))
        return less | (c.eqNullSafe(F.lit(v)) & rest)

    return reduce(step, reversed(list(zip(order, key))), F.lit(False))


def split_labels(df: DataFrame, test_size: float = TEST_SIZE, val_size: float = VAL_SIZE,
                 order: Sequence[str] = ("Date", "RegionName")) -> DataFrame:
    """TRN-2 without the positions: the same labels as ``ordered_split``, by comparing each row with the first
    rows of the validation and the test split, so the wide rows stay where they are. Where a cut falls
    between rows that are equal in every column, the rows are numbered."""
    n = df.count()
    test_start = math.floor(float(n) * (1.0 - test_size))
    val_start = math.floor(float(test_start) * (1.0 - val_size))
    tied = df.withColumn("_tie", F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]))
    by = [*order, "_tie"]
    # a start behind the last row has no row: everything comes before it
    cuts = together(*[lambda k=k: _row_at(tied, by, k) if k < n else None for k in (val_start, test_start)])
    if any(cut and cut[1] for cut in cuts):
        return ordered_split(df, test_size, val_size, order).drop("position")
    before = [_comes_before(by, cut[0]) if cut else F.lit(True) for cut in cuts]
    split = F.when(before[0], F.lit("train")).when(before[1], F.lit("val")).otherwise(F.lit("test"))
    return tied.withColumn("split", split).drop("_tie")


def feature_matrix(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """TRN-3: features as doubles, invalid or NULL -> 0 (strings must be encoded first)."""
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features})


def scaler_statistics(df: DataFrame, features: Sequence[str], fit_filter=None) -> DataFrame:
    """SCL-1's fitted part: (feature, mean, scale), population std, zero std scales by 1;
    one pass over the rows of ``fit_filter``, whose cells are grouped by feature: one aggregate over all
    columns at once would be too long a method for the JVM to compile."""
    fit = df.where(fit_filter) if fit_filter is not None else df
    cells = fit.select(F.posexplode(F.array(*[F.col(f"`{c}`").cast("double") for c in features])).alias("_at", "_x"))
    stats = cells.groupBy("_at").agg(F.avg("_x").alias("_m"), F.stddev_pop("_x").alias("_s"))
    names = df.sparkSession.createDataFrame(list(enumerate(features)), "_at int, feature string")
    return names.join(stats, "_at", "left").orderBy("_at").select(
        "feature", F.coalesce("_m", F.lit(0.0)).alias("mean"), F.coalesce(F.nullif("_s", F.lit(0.0)), F.lit(1.0)).alias("scale"))


def standardize(df: DataFrame, features: Sequence[str], fit_filter=None) -> DataFrame:
    """SCL-1: (x - mean) / population std, fitted on the rows of ``fit_filter``
    (the train split); a zero std scales by 1. The fitted statistics are a row per feature."""
    fitted = {r["feature"]: r for r in scaler_statistics(df, features, fit_filter).collect()}
    return df.withColumns({c: (F.col(c) - F.lit(float(fitted[c]["mean"]))) / F.lit(float(fitted[c]["scale"])) for c in features})
