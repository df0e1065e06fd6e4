"""Moving-minute audit of the rate limits (STR-2): at each request, the client's requests of
its kind in the minute that ends with it. Tumbling minutes miss a burst across their border.

Batch: a RANGE frame per client and kind. A client may make a third of all requests, so
the frame does not run over the client's whole history: rows are cut into chunks of an hour,
and each chunk also gets the last minute of the one before, from the same scan.

Stream: every micro-batch is audited together with the rows that are still open: requests no
older than the watermark, and the minute before it. A request is reported once the watermark
has passed it; the open rows are the state, a version per batch. A request that comes later than the
watermark allows is not audited and is kept apart as late.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hearth.session import scratch_path
from hearth.streaming.requests import BATCH_LIMIT, RATE_LIMITS
from hearth.streaming.state import VersionedState

MINUTE = 60_000_000  # microseconds
CHUNK = 60 * MINUTE
DELAY = 10 * MINUTE

LOG = "event_id long, ts timestamp, client long, kind string"
REPORT = f"{LOG}, requests long, limit int, flagged boolean"


def limit_of(kind="kind"):
    """Fixed limits by kind; a kind without one of its own has the smallest."""
    return F.coalesce(*[F.when(F.col(kind) == k, F.lit(v)) for k, v in RATE_LIMITS.items()], F.lit(BATCH_LIMIT))


def moving_audit(log: DataFrame, span: int = MINUTE, chunk: int = CHUNK) -> DataFrame:
    """``log(event_id, ts, client, kind)`` with requests (of the client and kind in the ``span``
    microseconds that end at ts, those of the same instant included), limit and flagged. Rows without a time are left out."""
    at = F.unix_micros("ts")
    own = F.floor(at / F.lit(chunk))
    places = F.when(F.pmod(at, F.lit(chunk)) > chunk - span, F.array(F.struct(own.alias("chunk"), F.lit(True).alias("own")), F.struct((own + 1).alias("chunk"), F.lit(False).alias("own"))))
    places = places.otherwise(F.array(F.struct(own.alias("chunk"), F.lit(True).alias("own"))))
    rows = log.where("ts IS NOT NULL").select("event_id", "ts", "client", "kind", at.alias("_us"), F.inline(places))
    w = Window.partitionBy("client", "kind", "chunk").orderBy("_us").rangeBetween(-(span - 1), 0)
    rows = rows.withColumn("requests", F.count(F.lit(1)).over(w)).where("own")
    return rows.select("event_id", "ts", "client", "kind", "requests", limit_of().alias("limit"), (F.col("requests") > limit_of()).alias("flagged"))


class StreamAudit:
    """The streaming twin: open rows, reported rows and late rows under one folder. All rows of
    the state carry the watermark that was reached (microseconds)."""

    def __init__(self, spark: SparkSession, folder: str | None = None, span: int = MINUTE, delay: int = DELAY):
        self.spark, self.folder, self.span, self.delay = spark, folder or scratch_path(spark, "moving-audit"), span, delay
        self.open = VersionedState(spark, f"{self.folder}/open", f"{LOG}, mark long")

    def add_batch(self, batch: DataFrame, n: int) -> None:
        """One micro-batch; running it again writes the same rows to the same places."""
        at = F.unix_micros("ts")
        before, batch = self.open.before(n), batch.where("ts IS NOT NULL").select("event_id", "ts", "client", "kind")
        old = before.agg(F.max("mark")).first()[0]
        newest = batch.agg(F.max(at)).first()[0]
        if newest is None:
            return
        mark = newest - self.delay if old is None else max(old, newest - self.delay)
        late = F.lit(False) if old is None else at <= old
        rows = before.drop("mark").unionByName(batch.where(~late))
        due = moving_audit(rows, self.span).where(at <= mark)
        (due if old is None else due.where(at > old)).write.mode("overwrite").parquet(f"{self.folder}/reported/batch={n}")
        batch.where(late).write.mode("overwrite").parquet(f"{self.folder}/late/batch={n}")
        self.open.write(rows.where(at > mark - self.span).withColumn("mark", F.lit(mark).cast("long")), n)

    def run(self, log: DataFrame) -> StreamAudit:
        q = (log.writeStream.option("checkpointLocation", f"{self.folder}/checkpoint").foreachBatch(self.add_batch)
             .trigger(availableNow=True).start())
        q.awaitTermination()
        return self

    def _read(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":  # only a stream without any batch leaves no folder
                raise
            return self.spark.createDataFrame([], schema)

    def reported(self) -> DataFrame:
        """Audited requests that the watermark has passed."""
        return self._read("reported", REPORT)

    def pending(self) -> DataFrame:
        """The audit, so far, of requests that the watermark has not passed."""
        rows = self.open.before()
        return moving_audit(rows.drop("mark"), self.span).join(rows.where(F.unix_micros("ts") > F.col("mark")).select("event_id"), "event_id", "left_semi")

    def late(self) -> DataFrame:
        """Requests that came too late to be audited."""
        return self._read("late", LOG)
