"""Registered queries: Structured Streaming. Each stream is drained
with ``availableNow`` and its sink read back; the oracle is the batch SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from hearth.plans.queries_scoring import AS_OF, _SCORE_COLS, _SCORE_DOUBLES, _latest, _req_sql, _rsel
from hearth.plans.registry import register
from hearth.sources import panels as P
from hearth.streaming import limits, running
from hearth.streaming import requests as S

_KIND = ("CASE WHEN event_type = 'purchase' THEN 'prediction' WHEN event_type = 'error' THEN 'error' "
         "ELSE 'other' END")


@register("stream_daily_counts",
          "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS window_start, "
          "strftime(date_trunc('day', ts) + INTERVAL 1 DAY, '%Y-%m-%d %H:%M:%S') AS window_end, "
          f"{_KIND} AS kind, count(*) AS count FROM events GROUP BY 1, 2, 3")
def stream_daily_counts(spark, sf):
    return S.stream_daily_counts(spark, sf)


@register("stream_rate_audit",
          "SELECT strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M:%S') AS window_start, user_id AS client, kind, "
          "count(*) AS requests, CASE kind WHEN 'prediction' THEN 25 WHEN 'other' THEN 30 ELSE 10 END AS limit_per_minute, "
          "count(*) > CASE kind WHEN 'prediction' THEN 25 WHEN 'other' THEN 30 ELSE 10 END AS flagged "
          f"FROM (SELECT *, {_KIND} AS kind FROM events) e GROUP BY 1, 2, 3")
def stream_rate_audit(spark, sf):
    return S.stream_rate_audit(spark, sf)


@register("stream_score", _req_sql(f"SELECT {_rsel(_SCORE_COLS, _SCORE_DOUBLES)} FROM scored", scored=True))
def stream_score(spark, sf):
    return S.stream_score(spark, sf, _latest(spark, sf), AS_OF).select(*_SCORE_COLS)


_DAYS = f"WITH d AS (SELECT {_KIND} AS kind, CAST(ts AS DATE) AS day, count(*) AS today FROM events WHERE ts IS NOT NULL GROUP BY 1, 2)\n"


@register("stream_running_totals", _DAYS + "SELECT kind, day, today, CAST(sum(today) OVER (PARTITION BY kind ORDER BY day) AS BIGINT) AS total FROM d")
def stream_running_totals(spark, sf):
    """STR-1: the running counters after each day; several files and micro-batches, late requests among them."""
    return running.running_totals(running.run(S.landed_log(spark, sf)).before())


@register("stream_app_stats", _DAYS + "SELECT CAST(coalesce(sum(today) FILTER (WHERE kind = 'prediction'), 0) AS BIGINT) AS predictions_total, "
          "coalesce(max_by(today, day) FILTER (WHERE kind = 'prediction'), 0) AS predictions_today, max(day) FILTER (WHERE kind = 'prediction') AS last_reset, "
          "CAST(coalesce(sum(today) FILTER (WHERE kind = 'error'), 0) AS BIGINT) AS errors_count, "
          "CAST(coalesce(sum(today) FILTER (WHERE kind = 'other'), 0) AS BIGINT) AS other_total FROM d")
def stream_app_stats(spark, sf):
    """STR-1: the service's counters as they stand."""
    return running.app_stats(running.run(S.landed_log(spark, sf)).before())


_MOVING = ("WITH e AS (SELECT event_id, ts, user_id AS client, " + _KIND + " AS kind FROM events WHERE ts IS NOT NULL),\n"
           "m AS (SELECT *, count(*) OVER (PARTITION BY client, kind ORDER BY epoch_us(ts) RANGE BETWEEN 59999999 PRECEDING AND CURRENT ROW) AS requests, "
           "CASE kind WHEN 'prediction' THEN 25 WHEN 'other' THEN 30 ELSE 10 END AS limit_per_minute FROM e)\n"
           "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at, client, kind, requests, limit_per_minute, requests > limit_per_minute AS flagged FROM m")


def _moving(df):
    return df.select("event_id", S._fmt("ts").alias("at"), "client", "kind", "requests", F.col("limit").alias("limit_per_minute"), "flagged")


@register("moving_rate_audit", _MOVING)
def moving_rate_audit(spark, sf):
    """STR-2: each request with its client's requests of the kind in the minute that ends with it."""
    return _moving(limits.moving_audit(P.request_log(spark, sf)))


@register("stream_moving_audit", _MOVING)
def stream_moving_audit(spark, sf):
    """STR-2 as a stream over several files: what the watermark has passed, and the open rest."""
    audit = limits.StreamAudit(spark).run(S.landed_log(spark, sf, in_order=True))
    return _moving(audit.reported().drop("batch").unionByName(audit.pending()))
