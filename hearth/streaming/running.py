"""Running counters of the request log as continuing state (STR-1): totals since the start,
counts of the day that begin anew at the date change, errors.

The reference counts in one process, by arrival. Here a request counts on the day of its
time stamp, in whatever batch and order it comes: the state is the count per kind and
day (a calendar of rows), each micro-batch adds its own counts, and totals are running sums
over the days of a kind. A late request so raises its own day and all later totals.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hearth.session import scratch_path
from hearth.streaming.state import VersionedState

STATE = "kind string, day date, count long"


def add_batch(state: VersionedState, log: DataFrame, batch: int) -> None:
    """One micro-batch of ``log(ts, kind)`` into the state; running it again changes nothing."""
    new = log.where("ts IS NOT NULL").groupBy("kind", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("count"))
    both = state.before(batch).unionByName(new).groupBy("kind", "day").agg(F.sum("count").alias("count"))
    state.write(both, batch)


def run(log: DataFrame, folder: str | None = None) -> VersionedState:
    """Feeds a stream to its end into the state under ``folder``; started again with the same
    folder it goes on where it stopped."""
    spark = log.sparkSession
    folder = folder or scratch_path(spark, "running")
    state = VersionedState(spark, f"{folder}/state", STATE)
    q = (log.writeStream.option("checkpointLocation", f"{folder}/checkpoint").foreachBatch(lambda batch, n: add_batch(state, batch, n))
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return state


def running_totals(counts: DataFrame) -> DataFrame:
    """(kind, day, today, total) from the state: a window over the days of one kind."""
    w = Window.partitionBy("kind").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return counts.select("kind", "day", F.col("count").alias("today"), F.sum("count").over(w).alias("total"))


def app_stats(counts: DataFrame) -> DataFrame:
    """The service's counters after all that was read, as one row: predictions in total and of the
    day of the last one (when the daily counter was last set back), errors, all other requests."""
    def total(kind: str):
        return F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("count"))), F.lit(0).cast("long"))

    last = F.max(F.when(F.col("kind") == "prediction", F.struct("day", "count")))
    return counts.agg(total("prediction").alias("predictions_total"), F.coalesce(last["count"], F.lit(0).cast("long")).alias("predictions_today"),
                      last["day"].alias("last_reset"), total("error").alias("errors_count"), total("other").alias("other_total"))
