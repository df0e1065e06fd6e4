"""As-of join: to each left row the last right row of its key at or before its time.

A window over one key's rows would gather a hot key in one task. Here only distinct
(key, time) pairs of both sides are ordered: ``prefix_counts`` numbers the right rows of a
key over range partitions, and a left time gets the number of right rows at or before it.
Then plain equi-joins bring the row of that number to the left rows, which
keep their place if the small side is small, and whose hot keys AQE splits if not.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearth.operators.order_stats import prefix_counts
from hearth.session import materialize


def as_of_matches(left: DataFrame, right: DataFrame, left_key: str, left_time: str, right_key: str, right_time: str) -> DataFrame:
    """(_key, _time, _at): each distinct key and time of ``left`` with the time of the last
    ``right`` row at or before it; pairs without such a row are left out."""
    asked = left.select(F.col(left_key).alias("_key"), F.col(left_time).alias("_time"), F.lit(0).cast("long").alias("_right"), F.lit(True).alias("_asked"))
    given = right.select(F.col(right_key).alias("_key"), F.col(right_time).alias("_time"), F.lit(1).cast("long").alias("_right"), F.lit(False).alias("_asked"))
    pairs = asked.unionByName(given).where("_key IS NOT NULL AND _time IS NOT NULL")
    pairs = pairs.groupBy("_key", "_time").agg(F.max("_right").alias("_right"), F.max("_asked").alias("_asked"))
    numbered = prefix_counts(pairs, ["_key"], ["_time"], "_right")
    # written once: both sides of the next join read it
    numbered = materialize(numbered.select("_key", "_time", "_asked", "_right", (F.col("_before") + F.col("_right")).alias("_number")), "as-of")
    rows = numbered.where("_right = 1").select("_key", "_number", F.col("_time").alias("_at"))
    return numbered.where("_asked").select("_key", "_time", "_number").join(rows, ["_key", "_number"]).select("_key", "_time", "_at")


def as_of_join(left: DataFrame, right: DataFrame, left_key: str, left_time: str, right_key: str, right_time: str, values: Sequence[str],
               at: str = "matched_time") -> DataFrame:
    """All ``left`` rows with ``values`` of the matched right row and its time as ``at``; both null
    where no right row of the key is old enough, or key or time is null. ``right`` is taken to have one
    row per key and time; of several the greatest (by the values in turn) counts."""
    matches = materialize(as_of_matches(left, right, left_key, left_time, right_key, right_time), "as-of-matches")
    one = right.groupBy(F.col(right_key).alias("_rkey"), F.col(right_time).alias("_rtime")).agg(F.max(F.struct(*values)).alias("_values"))
    known = materialize(matches.join(one, (F.col("_key") == F.col("_rkey")) & (F.col("_at") == F.col("_rtime"))).select(
        "_key", "_time", F.col("_at").alias(at), *[F.col(f"_values.{v}").alias(v) for v in values]), "as-of-values")
    return left.join(known, (left[left_key] == known["_key"]) & (left[left_time] == known["_time"]), "left").drop("_key", "_time")
