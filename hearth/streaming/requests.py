"""Structured Streaming over the service's request log and request feed
(STR-1..3): the reference's process-global counters and per-client rate limits
re-aimed as windowed streaming aggregations, and scoring as a stateless stream.

Sinks are ``foreachBatch`` appends of each micro-batch's updated rows, tagged
with the batch id, into the shared checkpoint folder (as is the stream's own
checkpoint). Update mode keeps the state bounded by the watermark; reading the
sink back keeps each key's row from its latest batch, so a replayed batch after
a failure leaves the result unchanged.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hearth.operators.scoring import Forecasters
from hearth.session import scratch_path
from hearth.sources import panels as P

# The reference's per-minute limits (predict, other endpoints).
RATE_LIMITS = {"prediction": 25, "other": 30}
# ... and of the endpoints that work on a whole batch of requests.
BATCH_LIMIT = 10
DAILY_WATERMARK = "1 day"
MINUTE_WATERMARK = "10 minutes"


def _source(spark: SparkSession, sf_dir: str, table: str, columns: Sequence[str]) -> DataFrame:
    """File-stream source over one of the driver's Parquet tables: that table's file or
    folder and no other whose name begins alike."""
    root = sf_dir.rstrip("/")
    schema = spark.read.parquet(f"{root}/{table}.parquet").select(*columns).schema
    return spark.readStream.schema(schema).parquet(f"{root}/{table}.parque[t]").select(*columns)


def drain(stream: DataFrame, name: str, keys: Sequence[str] | None, mode: str = "update") -> DataFrame:
    """Run ``stream`` until its input is exhausted (``availableNow``) and return
    the sink as a batch DataFrame (latest batch per key when ``keys`` given)."""
    spark = stream.sparkSession
    base = scratch_path(spark, name)
    out = f"{base}/data"

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("_batch", F.lit(batch_id).cast("long")).write.mode("append").parquet(out)

    q = (stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/checkpoint")
         .foreachBatch(write).trigger(availableNow=True).start())
    q.awaitTermination()
    schema = stream.schema.add("_batch", "long")
    try:
        res = spark.read.schema(schema).parquet(out)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":  # only a stream without any batch leaves no folder
            raise
        res = spark.createDataFrame([], schema)
    if keys:
        w = Window.partitionBy(*keys).orderBy(F.col("_batch").desc())
        res = res.withColumn("_k", F.row_number().over(w)).where(F.col("_k") == 1).drop("_k")
    return res.drop("_batch")


def request_log_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _source(spark, sf_dir, "events", ["event_id", "ts", "user_id", "event_type"])
    return P.request_log_from_events(e)


def landed_log(spark: SparkSession, sf_dir: str, files: int = 4, in_order: bool = False) -> DataFrame:
    """The request log as a service lands it: several files, each one micro-batch. Without order every
    file holds requests of the whole time, so all but the first bring late ones; in order they
    follow each other but for some minutes of jitter."""
    events = spark.read.parquet(f"{sf_dir.rstrip('/')}/events.parquet").select("event_id", "ts", "user_id", "event_type")
    jitter = F.pmod(F.xxhash64("event_id"), F.lit(480))
    second = F.unix_timestamp(F.col("ts").cast("timestamp")) + jitter if in_order else F.pmod(F.xxhash64("event_id"), F.lit(1000))
    cuts = events.agg(F.percentile_approx(second, [k / files for k in range(1, files)])).first()[0] or []
    part = sum((F.when(second > c, 1).otherwise(0) for c in cuts), F.lit(0))
    root = scratch_path(spark, "landed")
    for k in range(files):  # one after the other: the stream takes files by age
        events.where(part == k).coalesce(1).write.mode("append").parquet(f"{root}/events.parquet")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/events.parque[t]")
    return P.request_log_from_events(stream)


def _fmt(c) -> F.Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def daily_counts(log: DataFrame) -> DataFrame:
    """STR-1: requests per day and kind (tumbling 1-day windows, watermarked)."""
    return log.withWatermark("ts", DAILY_WATERMARK).groupBy(F.window("ts", "1 day"), "kind").agg(
        F.count(F.lit(1)).alias("count"))


def rate_audit(log: DataFrame) -> DataFrame:
    """STR-2: requests per client, kind and minute against the per-minute limits (a kind
    without a limit of its own, errors among them, has the smallest). Every request
    counts, also one that fails. It audits the log; it does not block anything."""
    limits = F.coalesce(*[F.when(F.col("kind") == k, F.lit(v)) for k, v in RATE_LIMITS.items()], F.lit(BATCH_LIMIT))
    return log.withWatermark("ts", MINUTE_WATERMARK).groupBy(
        F.window("ts", "1 minute"), "client", "kind").agg(F.count(F.lit(1)).alias("requests")).withColumn(
        "limit", limits)


def stream_daily_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    res = drain(daily_counts(request_log_stream(spark, sf_dir)), "daily-counts", ["window", "kind"])
    return res.select(_fmt(F.col("window.start")).alias("window_start"), _fmt(F.col("window.end")).alias("window_end"),
                      "kind", "count")


def stream_rate_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    res = drain(rate_audit(request_log_stream(spark, sf_dir)), "rate-audit", ["window", "client", "kind"])
    return res.select(_fmt(F.col("window.start")).alias("window_start"), "client", "kind", "requests",
                      F.col("limit").alias("limit_per_minute"), (F.col("requests") > F.col("limit")).alias("flagged"))


def stream_score(spark: SparkSession, sf_dir: str, latest: DataFrame | None, as_of: str, models: Forecasters | None = None) -> DataFrame:
    """STR-3: requests scored as they arrive: stateless rules plus a stream-static
    join with the latest region rows, or fitted ``models`` loaded from their bundles; append mode."""
    from hearth.operators.scoring import score
    c = _source(spark, sf_dir, "customer", ["c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment"])
    scored = score(P.requests_from_customer(c, P.region_count(spark, sf_dir)), latest, as_of, models=models)
    if models is not None:  # the sink holds plain columns
        scored = scored.drop("features")
    return drain(scored, "stream-score", ["request_id"], mode="append")
