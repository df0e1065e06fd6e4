"""Running state, moving limits, as-of joins and reproducible draws against plain Python."""

import datetime as dt
import random
import struct
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from conftest import SF001
from hearth.operators import scoring as sc
from hearth.operators.asof import as_of_join
from hearth.streaming import limits, running
from hearth.streaming import requests as S
from hearth.streaming.state import VersionedState

T0 = dt.datetime(2024, 3, 1, 12, 0, 0)
LOG = "event_id long, ts timestamp, client long, kind string"


def log_rows(n, seed, seconds=900):
    rng = random.Random(seed)
    return [(i, T0 + dt.timedelta(microseconds=rng.randint(0, seconds * 1_000_000)), rng.choice([1, 1, 1, 2, 3]), rng.choice(["prediction", "other", "error"]))
            for i in range(n)]


def days(rows):
    n = Counter((k, t.date()) for _, t, _, k in rows if t)
    total = {(k, d): sum(v for (k2, d2), v in n.items() if k2 == k and d2 <= d) for k, d in n}
    return {(k, d, v, total[k, d]) for (k, d), v in n.items()}


# --- running state -----------------------------------------------------------------


def test_running_totals_over_batches_with_late_rows_and_replay(spark, tmp_path):
    rows = log_rows(300, 1, seconds=6 * 86_400)
    random.Random(2).shuffle(rows)
    parts = [rows[:100], rows[100:120], [], rows[120:]]
    state = VersionedState(spark, str(tmp_path / "state"), running.STATE)
    for n, part in enumerate(parts):
        batch = spark.createDataFrame(part + [(None, None, None, "other")] * (n == 1), LOG)
        running.add_batch(state, batch, n)
        running.add_batch(state, batch, n)  # the batch runs again: nothing changes
        assert {tuple(r) for r in running.running_totals(state.before()).collect()} == days([r for p in parts[:n + 1] for r in p])
    assert state.versions() == [2, 3]
    got = running.app_stats(state.before()).first()
    pred = [t.date() for _, t, _, k in rows if k == "prediction"]
    assert (got.predictions_total, got.predictions_today, got.last_reset) == (len(pred), pred.count(max(pred)), max(pred))
    assert got.errors_count == sum(k == "error" for *_, k in rows)


def test_a_batch_that_broke_off_is_written_anew(spark, tmp_path):
    state = VersionedState(spark, str(tmp_path / "state"), running.STATE)
    rows = log_rows(50, 3)
    running.add_batch(state, spark.createDataFrame(rows[:30], LOG), 0)
    (tmp_path / "state" / "v=1").mkdir()
    (tmp_path / "state" / "v=1" / "part-0.parquet").write_bytes(b"half a file")
    running.add_batch(state, spark.createDataFrame(rows[30:], LOG), 1)
    assert {tuple(r) for r in running.running_totals(state.before()).collect()} == days(rows)


def test_stream_goes_on_where_it_stopped(spark, tmp_path):
    rows = log_rows(90, 4, seconds=3 * 86_400)
    folder = str(tmp_path / "in")
    schema = spark.createDataFrame([], LOG).schema
    for k in range(3):
        spark.createDataFrame(rows[30 * k:30 * k + 30], LOG).coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
        state = running.run(stream, str(tmp_path / "job"))
        assert {tuple(r) for r in running.running_totals(state.before()).collect()} == days(rows[:30 * k + 30])


def test_counters_of_no_requests(spark, tmp_path):
    state = VersionedState(spark, str(tmp_path / "none"), running.STATE)
    assert running.running_totals(state.before()).count() == 0
    assert tuple(running.app_stats(state.before()).first()) == (0, 0, None, 0, 0)


# --- moving minute -----------------------------------------------------------------------


def moving(rows, span=60_000_000):
    groups = defaultdict(list)
    for i, t, c, k in rows:
        groups[c, k].append((i, t))
    out = {}
    for (c, k), own in groups.items():
        for i, t in own:
            n = sum(dt.timedelta(0) <= t - u < dt.timedelta(microseconds=span) for _, u in own)
            limit = limits.RATE_LIMITS.get(k, limits.BATCH_LIMIT)
            out[i] = (t, c, k, n, limit, n > limit)
    return out


def as_dict(df):
    rows = df.collect()
    assert len({r.event_id for r in rows}) == len(rows)
    return {r.event_id: (r.ts, r.client, r.kind, r.requests, r.limit, r.flagged) for r in rows}


@pytest.mark.parametrize("chunk", [60_000_000, 90_000_000, 3_600_000_000])
def test_moving_minute_against_brute_force(spark, chunk):
    rows = log_rows(600, 5, seconds=400)
    rows += [(1000 + i, T0 + dt.timedelta(seconds=60 * i), 9, "error") for i in range(5)]  # exactly a minute apart
    rows += [(2000 + i, T0, 8, "error") for i in range(12)] + [(3000, T0 + dt.timedelta(seconds=59, microseconds=999_999), 8, "error")]
    log = spark.createDataFrame(rows + [(9999, None, 1, "other")], LOG)
    got = as_dict(limits.moving_audit(log, chunk=chunk))
    assert got == moving(rows)
    assert got[1004][3] == 1 and got[3000][3] == 13 and got[3000][5]


def test_moving_minute_sees_a_burst_across_the_border(spark):
    rows = [(i, T0 + dt.timedelta(seconds=50 + i), 1, "error") for i in range(20)]  # 10 in each of two tumbling minutes
    assert any(v[5] for v in as_dict(limits.moving_audit(spark.createDataFrame(rows, LOG))).values())


def test_moving_stream_equals_batch_replays_and_keeps_late_rows_apart(spark, tmp_path):
    rows = sorted(log_rows(500, 6), key=lambda r: r[1] + dt.timedelta(seconds=random.Random(r[0]).randint(0, 40)))
    audit = limits.StreamAudit(spark, str(tmp_path), delay=60_000_000)
    sizes = [0, 150, 170, 400, 500]
    for n, (a, b) in enumerate(zip(sizes, sizes[1:])):
        batch = spark.createDataFrame(rows[a:b], LOG)
        audit.add_batch(batch, n)
        audit.add_batch(batch, n)
    audit.add_batch(spark.createDataFrame([], LOG), 4)
    audit.add_batch(spark.createDataFrame([(7777, T0, 1, "other")], LOG), 5)  # older than the watermark
    both = audit.reported().drop("batch").unionByName(audit.pending())
    assert as_dict(both) == moving(rows) and audit.pending().count() > 0
    assert [r.event_id for r in audit.late().collect()] == [7777]


def test_moving_stream_from_files(spark):
    audit = limits.StreamAudit(spark).run(S.landed_log(spark, SF001, in_order=True))
    want = {r.event_id for r in spark.read.parquet(f"{SF001}/events.parquet").collect()}
    assert {r.event_id for r in audit.reported().collect()} | {r.event_id for r in audit.pending().collect()} == want
    assert audit.late().count() == 0


# --- as of -----------------------------------------------------------------------------------


def test_as_of_join_against_brute_force(spark):
    rng = random.Random(7)
    day = lambda n: dt.date(2020, 1, 1) + dt.timedelta(days=n)
    right = [(f"r{rng.randint(0, 9)}", day(30 * rng.randint(0, 20)), float(i), i) for i in range(120)]
    right += [("r0", None, 1.0, 1), (None, day(1), 1.0, 1)]
    left = [(i, rng.choice(["r0"] * 6 + [f"r{k}" for k in range(12)]), day(rng.randint(-40, 700))) for i in range(1500)]  # r0 is hot
    left += [(5000, None, day(9)), (5001, "r1", None), (5001, "r1", None)]
    df = as_of_join(spark.createDataFrame(left, "id long, region string, as_of date"), spark.createDataFrame(right, "RegionName string, Date date, a double, b long"),
                    "region", "as_of", "RegionName", "Date", ["a", "b"])
    assert df.columns == ["id", "region", "as_of", "matched_time", "a", "b"]
    want = Counter()
    for i, k, t in left:
        known = [(d, a, b) for r, d, a, b in right if r == k and k is not None and t is not None and d is not None and d <= t]
        want[(i, k, t, *(max(known) if known else (None, None, None)))] += 1
    assert Counter(map(tuple, df.collect())) == want
    assert all(r.matched_time is None or r.matched_time <= r.as_of for r in df.collect())


def test_as_of_join_of_no_rows(spark):
    left = spark.createDataFrame([(1, "a", dt.date(2020, 1, 1))], "id long, region string, as_of date")
    right = spark.createDataFrame([], "RegionName string, Date date, a double")
    assert [tuple(r) for r in as_of_join(left, right, "region", "as_of", "RegionName", "Date", ["a"]).collect()] == [(1, "a", dt.date(2020, 1, 1), None, None)]
    assert as_of_join(left.limit(0), right, "region", "as_of", "RegionName", "Date", ["a"]).count() == 0


def test_latest_rows_are_of_the_day_or_earlier(spark):
    rows = spark.createDataFrame([("a", dt.date(2020, m, 1), float(m)) for m in (1, 2, 3)], "RegionName string, Date date, Value double")
    assert [r.Value for r in sc.latest_region_rows(rows, as_of="2020-02-15").collect()] == [2.0]
    assert [r.Value for r in sc.latest_region_rows(rows).collect()] == [3.0]


# --- draws -----------------------------------------------------------------------------------


def drawn(key, seed, stream):
    h = 42
    for x in (key, seed, stream):
        h = xxhash.xxh64_intdigest(struct.pack("<q", x), h)
    return (h >> 11) / (1 << 53)


def test_draws_are_the_hash_and_do_not_depend_on_partitions(spark):
    ids = spark.range(4000).select(F.col("id").alias("request_id"))
    one = {r[0]: r[1] for r in ids.coalesce(1).select("request_id", sc.uniform(F.col("request_id"), 7, 2)).collect()}
    many = {r[0]: r[1] for r in ids.repartition(9).orderBy(F.desc("request_id")).select("request_id", sc.uniform(F.col("request_id"), 7, 2)).collect()}
    assert one == many and all(one[k] == drawn(k, 7, 2) for k in range(0, 4000, 37))
    assert 0 <= min(one.values()) and max(one.values()) < 1 and abs(sum(one.values()) / 4000 - 0.5) < 0.02
    other = {r[0]: r[1] for r in ids.select("request_id", sc.uniform(F.col("request_id"), 8, 2)).collect()}
    assert sum(other[k] == one[k] for k in one) == 0


def test_adjustment_is_drawn_within_its_bounds(spark):
    req = spark.range(3000).select(F.col("id").alias("request_id"), F.element_at(F.array(*[F.lit(x) for x in (50e3, 500e3, 5e6)]), (F.col("id") % 3 + 1).cast("int")).alias("current_value"),
                                   F.when(F.col("id") % 2 == 0, "CA").otherwise("OH").alias("state"))
    rows = req.withColumns({**sc.market_adjustment(), "drawn": sc.adjustment_draw(11)}).collect()
    assert all(r.adj_low - 1e-12 <= r.drawn <= r.adj_high + 1e-12 for r in rows)
    for value, state in ((50e3, "CA"), (5e6, "OH"), (50e3, "OH")):
        own = [r for r in rows if r.current_value == value and r.state == state]
        assert abs(sum(r.drawn for r in own) / len(own) - own[0].adj_mid) < 0.04
    assert all(r.drawn == 0 for r in rows if r.current_value == 500e3 and r.state == "OH")
