"""Exact order statistics that never put one group into one task.

Spark's ``rank().over(partitionBy(g))`` and the exact ``percentile``/``median``
aggregates both gather a whole group in one task (the window sorts the group; the
aggregate merges the group's value->count map). With a hot group holding a third
of all rows that is one task for a third of the data. Everything here is built
on *prefix counts* instead:

1. pre-aggregate to distinct ``(group, value) -> n`` (map-side combine, so even a
   single hot value costs one row per map task);
2. range-partition those rows on ``(group, value)`` -- a hot group is split over
   many partitions by value, and the sampled bounds balance the partitions;
3. inside each range partition a running sum gives the count before each value
   locally; a small table of per-partition totals gives each partition's offset
   within its group.

``before(value)`` = rows of the group that sort strictly earlier. From it:
average-tie rank = before + (n + 1) / 2, and the k-th order statistic is the value
whose run ``[before, before + n)`` contains k.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearth.functions.exprs import all_not_null
from hearth.session import materialize


def _num_partitions(df: DataFrame, num_partitions: int | None) -> int:
    if num_partitions:
        return int(num_partitions)
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def prefix_counts(
    df: DataFrame,
    group_cols: Sequence[str],
    order_cols: Sequence[str],
    weight_col: str | None = None,
    ascending: bool = True,
    num_partitions: int | None = None,
) -> DataFrame:
    """Add ``_before`` (sum of weights of rows of the same group that sort strictly
    earlier by ``order_cols``) and ``_total`` (the group's total weight).

    ``(group_cols, order_cols)`` should be unique per row (pre-aggregate first);
    rows with a NULL group key are dropped, as grouping in the reference drops them.
    """
    group_cols, order_cols = list(group_cols), list(order_cols)
    if weight_col is None:
        df = df.withColumn("_w", F.lit(1).cast("long"))
        weight_col = "_w"
    df = df.where(all_not_null(group_cols))
    n = _num_partitions(df, num_partitions)

    def ordered(c: str) -> Column:
        return F.col(c).asc_nulls_first() if ascending else F.col(c).desc_nulls_last()

    range_keys = [F.col(g).asc() for g in group_cols] + [ordered(o) for o in order_cols]
    # Range bounds are sampled, so two runs of this exchange may cut differently. The cut
    # table is written once, with the partition id as a stored column; the running sums and
    # the offsets below both read that file and so always agree.
    ranged = materialize(df.repartitionByRange(n, *range_keys).withColumn("_pid", F.spark_partition_id()), "ranged")

    local_w = Window.partitionBy("_pid", *group_cols).orderBy(*[ordered(o) for o in order_cols])
    local = ranged.withColumn(
        "_local", F.coalesce(F.sum(weight_col).over(local_w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    )

    # One row per (partition, group): at most #groups + #partitions rows.
    totals = ranged.groupBy("_pid", *group_cols).agg(F.sum(weight_col).alias("_pt"))
    off_w = Window.partitionBy(*group_cols).orderBy("_pid") if group_cols else Window.orderBy("_pid")
    all_w = Window.partitionBy(*group_cols) if group_cols else Window.partitionBy()
    offsets = totals.select(
        "_pid",
        *group_cols,
        F.coalesce(F.sum("_pt").over(off_w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"),
        F.sum("_pt").over(all_w).alias("_total"),
    )
    out = local.join(offsets, on=["_pid", *group_cols], how="inner")
    out = out.withColumn("_before", (F.col("_local") + F.col("_off")).cast("long"))
    drop = ["_pid", "_local", "_off"] + (["_w"] if weight_col == "_w" else [])
    return out.drop(*drop)


def _value_counts(df: DataFrame, group_cols: Sequence[str], value_col: str) -> DataFrame:
    v = F.col(value_col)
    valid = df.where(all_not_null([*group_cols, value_col]) & ~F.isnan(v.cast("double")))
    return valid.groupBy(*group_cols, value_col).agg(F.count(F.lit(1)).alias("_n"))


def average_rank_table(
    df: DataFrame,
    group_cols: Sequence[str],
    value_col: str,
    *,
    ascending: bool = True,
    pct: bool = False,
    out: str = "rank",
    num_partitions: int | None = None,
) -> DataFrame:
    """``(group_cols, value_col, out)``: average-tie rank of each distinct value
    (pandas ``rank(method='average')``; ``pct`` divides by the group's row count)."""
    group_cols = list(group_cols)
    counts = _value_counts(df, group_cols, value_col)
    pc = prefix_counts(counts, group_cols, [value_col], "_n", ascending, num_partitions)
    rank = F.col("_before").cast("double") + (F.col("_n").cast("double") + F.lit(1.0)) / F.lit(2.0)
    if pct:
        rank = rank / F.col("_total").cast("double")
    return pc.select(*group_cols, value_col, rank.alias(out))


def with_average_rank(
    df: DataFrame,
    group_cols: Sequence[str],
    value_col: str,
    *,
    ascending: bool = True,
    pct: bool = False,
    out: str = "rank",
    num_partitions: int | None = None,
) -> DataFrame:
    """Attach the average-tie rank to every row; NULL group or value gives NULL."""
    table = average_rank_table(df, group_cols, value_col, ascending=ascending, pct=pct, out=out,
                               num_partitions=num_partitions)
    return df.join(table, on=[*group_cols, value_col], how="left")


def exact_quantiles(
    df: DataFrame,
    group_cols: Sequence[str],
    value_col: str,
    probs: Mapping[str, float],
    num_partitions: int | None = None,
    extras: bool = False,
    runs: DataFrame | None = None,
) -> DataFrame:
    """Exact linear-interpolated quantiles per group (pandas ``quantile``, Spark
    ``percentile``, DuckDB ``quantile_cont``): one row per group with a column per
    entry of ``probs``. NULL/NaN values are skipped; NULL groups are dropped. ``runs``
    may give the table of ``value_runs``."""
    group_cols = list(group_cols)
    pc = runs
    if pc is None:
        pc = prefix_counts(_value_counts(df, group_cols, value_col), group_cols, [value_col], "_n", True, num_partitions)
    v = F.col(value_col).cast("double")
    start, stop = F.col("_before"), F.col("_before") + F.col("_n")
    aggs = []
    for name, p in probs.items():
        pos = (F.col("_total") - F.lit(1)).cast("double") * F.lit(float(p))
        lo, hi = F.floor(pos), F.ceil(pos)
        aggs += [
            F.max(F.when((start <= lo) & (lo < stop), v)).alias(f"_{name}_lo"),
            F.max(F.when((start <= hi) & (hi < stop), v)).alias(f"_{name}_hi"),
            F.max(pos - lo.cast("double")).alias(f"_{name}_t"),
        ]
    if extras:  # exact count / min / max from the same distinct-value table
        aggs += [F.sum("_n").alias("_count"), F.min(v).alias("_min"), F.max(v).alias("_max")]
    agg = pc.groupBy(*group_cols).agg(*aggs)
    outs = [F.col(c) for c in ("_count", "_min", "_max")] if extras else []
    for name in probs:
        a, b, t = F.col(f"_{name}_lo"), F.col(f"_{name}_hi"), F.col(f"_{name}_t")
        outs.append((a + (b - a) * t).alias(name))
    return agg.select(*group_cols, *outs)


def value_runs(df: DataFrame, group_cols: Sequence[str], value_col: str, num_partitions: int | None = None) -> DataFrame:
    """(group_cols, value, _n, _before, _total): the distinct values of each group with
    their counts and prefix counts, written once for readers that need them twice."""
    return materialize(prefix_counts(_value_counts(df, group_cols, value_col), group_cols, [value_col], "_n", True, num_partitions), "runs")


def group_stats(
    df: DataFrame,
    group_cols: Sequence[str],
    value_col: str,
    *,
    prefix: str = "",
    stats: Sequence[str] = ("mean", "median", "std", "count"),
    num_partitions: int | None = None,
) -> DataFrame:
    """pandas ``groupby(g)[v].agg([...])`` with an exact, skew-safe median.

    mean/std/min/max/count/sum are ordinary partial aggregates; quantiles go
    through ``exact_quantiles``. NULL group keys are dropped (pandas semantics)."""
    group_cols = list(group_cols)
    v = F.col(value_col)
    base = df.where(all_not_null(group_cols)) if group_cols else df
    simple = {
        "mean": F.avg(v), "std": F.stddev_samp(v), "count": F.count(v), "min": F.min(v), "max": F.max(v),
        "sum": F.sum(v),
    }
    quant = {"median": 0.5, "q25": 0.25, "q75": 0.75}
    aggs = [simple[s].alias(f"{prefix}{s}") for s in stats if s in simple]
    out = base.groupBy(*group_cols).agg(*aggs) if aggs else base.select(*group_cols).distinct()
    qs = {f"{prefix}{s}": quant[s] for s in stats if s in quant}
    if qs:
        q = exact_quantiles(base, group_cols, value_col, qs, num_partitions)
        if group_cols:
            out = out.join(q, on=group_cols, how="left")
        else:  # one row each: the quantiles become scalar subqueries, no join
            out = out.select("*", *[q.select(c).scalar().alias(c) for c in qs])
    return out.select(*group_cols, *[f"{prefix}{s}" for s in stats])
