"""Registered queries: catalogue, label encoding, ordered split, feature matrix,
standardization (SURVEY 2.3 PRJ-14, 2.9)."""

from __future__ import annotations

from pyspark.sql import functions as F

from hearth.operators import training as tr
from hearth.operators import targets as tg
from hearth.operators.targets import training_rows
from hearth.sources import panels as P
from hearth.plans import oracle as O
from hearth.plans.features import FEATURE_TABLE_COLUMNS, feature_table
from hearth.plans.queries_market import CHECKED_COLUMNS, feature_table_sql
from hearth.plans.registry import register
from hearth.session import materialize

R = O.rnd
TRAIN_WHERE = ("WHERE target_value_1m IS NOT NULL AND target_value_3m IS NOT NULL AND target_value_6m IS NOT NULL "
               "AND target_value_12m IS NOT NULL")
CATALOGUE = tr.catalogue_columns(CHECKED_COLUMNS)
FEATURES = [c for c in FEATURE_TABLE_COLUMNS if c not in ("RegionID", "RegionName", "Date", "Value", "Dataset",
                                                            "GeographyLevel") and not c.startswith("target_")]
#: What SQL can check: cluster ids are arbitrary.
CHECKED = [c for c in FEATURES if c != "GeographicCluster"]
CATEGORICAL = ["RegionType", "StateName", "State", "Metro", "CountyName", "MarketEra"]
TARGETS = list(tr.TARGETS)


def training_base(spark, sf, with_clusters=True):
    """Training rows of the feature table, materialized once: positions, codes
    and the split all read it several times."""
    return materialize(training_rows(feature_table(spark, sf, with_clusters)), "training")


def narrow_training_base(spark, sf):
    """The training rows with only what the split, the label codes and the
    persistence evaluation read: the home panel's columns, the era, lags and
    targets. The market panel keeps exactly the home rows (every LEFT JOIN right
    side is unique on its keys) and the training filter reads only the home
    series, so these are the same rows and values as in ``training_base``,
    without computing the other ~80 feature columns."""
    from hearth.operators import temporal as tm
    home = P.home_panel(spark, sf)
    w = tm.region_window()
    t = tm.with_market_era(home).withColumns(
        {f"Value_lag_{h}": F.lag("Value", h).over(w) for h in (1, 3, 6, 12)})
    return materialize(training_rows(tg.with_targets(t)), "training-narrow")


def split_frame(spark, sf, with_clusters=True):
    return tr.split_labels(training_base(spark, sf, with_clusters))


def narrow_split_frame(spark, sf):
    return tr.ordered_split(narrow_training_base(spark, sf))


def encoded_matrix(spark, sf, with_clusters=True):
    """Split rows with encoded categoricals and a numeric feature matrix."""
    df = split_frame(spark, sf, with_clusters)
    feats = FEATURES if with_clusters else CHECKED
    return tr.feature_matrix(tr.label_encode(df, CATEGORICAL), feats), feats


def _sql_base(extra: str = "") -> str:
    """CTE chain: ft (training rows, unrounded), sp (+ position, split)."""
    inner = feature_table_sql(TRAIN_WHERE, rounded=False)
    return (f"WITH ft AS ({inner}),\n"
            "sp AS (SELECT *, row_number() OVER (ORDER BY Date, RegionName) - 1 AS position, "
            "count(*) OVER () AS _n FROM ft),\n"
            "sp2 AS (SELECT *, CASE WHEN position < floor(floor(_n * 0.8) * 0.85) THEN 'train' "
            "WHEN position < floor(_n * 0.8) THEN 'val' ELSE 'test' END AS split FROM sp)" + extra)


# The type rule once more, in SQL: the first group with a matching part of the name.
_TYPE_SQL = ("CASE WHEN regexp_matches('{c}', 'lag|rolling|trend|pct_change') THEN 'temporal' "
             "WHEN regexp_matches('{c}', 'State|Metro|Cluster') THEN 'geographic' "
             "WHEN regexp_matches('{c}', 'Ratio|Supply|National') THEN 'market_dynamics' "
             "WHEN regexp_matches('{c}', 'Year|Month|Quarter') THEN 'time' ELSE 'other' END")


_CATALOGUE_SQL = ("WITH ft AS (" + feature_table_sql(rounded=False) + ")\n"
          "SELECT Feature, Type, position, non_null FROM (UNPIVOT (SELECT "
          + ", ".join(f"count({c}) AS c{i}" for i, c in enumerate(CATALOGUE)) + " FROM ft) ON "
          + ", ".join(f"c{i}" for i in range(len(CATALOGUE))) + " INTO NAME k VALUE non_null) u JOIN ("
          + " UNION ALL ".join(f"SELECT 'c{i}' AS k, '{c}' AS Feature, {_TYPE_SQL.format(c=c)} AS Type, {i} AS position"
                               for i, c in enumerate(CATALOGUE)) + ") t USING (k)")


@register("feature_catalogue", _CATALOGUE_SQL)
def feature_catalogue(spark, sf):
    return tr.feature_catalogue(feature_table(spark, sf, with_clusters=False))


@register("feature_type_counts", f"SELECT coalesce(Type, '{tr.TOTAL}') AS Type, count(*) AS features, CAST(sum(non_null) AS BIGINT) AS non_null "
          f"FROM ({_CATALOGUE_SQL}) c GROUP BY ROLLUP (Type)")
def feature_type_counts(spark, sf):
    """PRJ-14: the catalogue's counts per type, with a total row."""
    return tr.feature_type_counts(tr.feature_catalogue(feature_table(spark, sf, with_clusters=False)))


def _codes_sql(src: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, v AS value, CAST(dense_rank() OVER (ORDER BY v) - 1 AS INTEGER) AS code "
        f"FROM (SELECT DISTINCT coalesce(CAST({c} AS VARCHAR), 'nan') AS v FROM {src}) d{i}"
        for i, c in enumerate(CATEGORICAL))


@register("label_encode", _sql_base(f"\nSELECT * FROM ({_codes_sql('sp2')}) c"))
def label_encode(spark, sf):
    df = narrow_training_base(spark, sf)
    return tr.label_codes(df, CATEGORICAL)


@register("ordered_split", _sql_base("\nSELECT RegionName, Date, position, split FROM sp2"))
def ordered_split(spark, sf):
    return narrow_split_frame(spark, sf).select("RegionName", "Date", "position", "split")


def _matrix_sql(std: bool) -> str:
    codes = f",\ncodes AS ({_codes_sql('sp2')})"
    joins = " ".join(f"LEFT JOIN (SELECT value, code FROM codes WHERE column_name = '{c}') e_{c} "
                     f"ON coalesce(CAST(sp2.{c} AS VARCHAR), 'nan') = e_{c}.value" for c in CATEGORICAL)
    feats = ", ".join(
        (f"CAST(coalesce(e_{c}.code, 0) AS DOUBLE) AS {c}" if c in CATEGORICAL
         else f"coalesce(CAST(sp2.{c} AS DOUBLE), 0.0) AS {c}") for c in CHECKED)
    mat = f",\nmat AS (SELECT sp2.RegionName, sp2.Date, sp2.split, {feats}, " + ", ".join(
        f"sp2.{t}" for t in TARGETS) + f" FROM sp2 {joins})"
    if not std:
        return _sql_base(codes + mat + "\nSELECT RegionName, Date, split, " + ", ".join(
            f"{R(c)} AS {c}" for c in CHECKED + TARGETS) + " FROM mat")
    st = ",\nst AS (SELECT " + ", ".join(
        f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in CHECKED) + " FROM mat WHERE split = 'train')"
    sel = ", ".join(f"{R(f'({c} - m_{c}) / CASE WHEN s_{c} IS NULL OR s_{c} = 0 THEN 1.0 ELSE s_{c} END')} AS {c}"
                    for c in CHECKED)
    return _sql_base(codes + mat + st + f"\nSELECT RegionName, Date, split, {sel} FROM mat, st")


@register("feature_matrix", _matrix_sql(False))
def feature_matrix(spark, sf):
    m, feats = encoded_matrix(spark, sf, with_clusters=False)
    return m.select("RegionName", "Date", "split", *feats, *TARGETS)


@register("standardize", _matrix_sql(True))
def standardize(spark, sf):
    m, feats = encoded_matrix(spark, sf, with_clusters=False)
    return tr.standardize(m, feats, F.col("split") == "train").select("RegionName", "Date", "split", *feats)
