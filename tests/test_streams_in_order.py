"""Streams over shuffled files, one file a batch, against the batch operators."""

import datetime as dt
import os
import random

import pytest

from headway.operators import analytics as A
from headway.operators import limits as M
from headway.operators import tracking as K
from headway.streaming import jobs as J

T0 = dt.datetime(2024, 1, 10, 14, 0)
VISIT = "visit_id long, ts timestamp_ntz, path string, ip string, sid string, rid string, event_name string"
PING = "trip_id long, ts timestamp_ntz, lat double, lon double, on_vehicle boolean, rerouted boolean"
FAR = T0 + dt.timedelta(days=400)


@pytest.fixture()
def shuffled(spark, tmp_path):
    """A stream of the rows in shuffled files, one a batch; then the rows of `last`, which move the clock on."""
    def build(rows, schema, last, files=6, seed=1):
        rows = list(rows)
        random.Random(seed).shuffle(rows)
        folder = tmp_path / f"in{seed}-{len(os.listdir(tmp_path))}"
        parts = [rows[i::files] for i in range(files)] + [[r] for r in last]
        for i, part in enumerate(parts):
            spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(folder / f"b={i:03d}"))
            for name in os.listdir(folder / f"b={i:03d}"):
                os.utime(folder / f"b={i:03d}" / name, (1_700_000_000 + 10 * i,) * 2)
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder / "b=*"))
    return build


def visit(i, seconds, who, path="/ping", name=None):
    return (i, T0 + dt.timedelta(seconds=seconds), path, who, who, who, name)


def closing(who="zz"):
    return [(-i, FAR + dt.timedelta(days=i), "/ping", who, who, who, None) for i in (1, 2)]


def test_rate_limit(spark, shuffled):
    r = random.Random(5)
    rows = [visit(i, r.randrange(0, 9_000) // r.choice([1, 40]), r.choice("ab")) for i in range(90)]
    limit = M.Limit(2, 6, 20)
    want = {x.visit_id: x.allowed for x in M.rate_limit(spark.createDataFrame(rows, VISIT), limit).collect()}
    out = J.to_table(J.stream_rate_limit(shuffled(rows, VISIT, closing(), 5), limit, "1 day", in_order=True), "limits")
    assert {x.visit_id: x.allowed for x in out.collect() if x.visit_id >= 0} == want
    assert {True, False} == set(want.values())


def test_retention(spark, shuffled):
    r = random.Random(6)
    rows = [visit(i, r.randrange(0, 20 * 86_400), r.choice("abcd")) for i in range(70)]
    seen, want = {}, set()
    for _, ts, _, who, *_ in sorted(rows, key=lambda x: x[1]):
        day = str((ts - dt.timedelta(hours=6)).date())
        if day != seen.get(who):
            want.add((who, day, who in seen))
            seen[who] = day
    out = J.to_table(J.stream_retention(shuffled(rows, VISIT, closing(), 5), 500, "30 days", in_order=True), "retention")
    assert {tuple(x) for x in out.collect() if x.rid != "zz"} == want


def test_trips(spark, shuffled):
    r = random.Random(8)
    pings = [(i % 2, T0 + dt.timedelta(minutes=i * (1 if i < 60 else 6)), 41.9 + r.uniform(0, 0.012), -87.6, r.random() < 0.3, r.random() < 0.1)
             for i in range(90)]
    way = lambda *p: [{"lat": a, "lon": b} for a, b in p]
    legs = spark.createDataFrame([(t, n, k, way((41.9 + n * 0.004, -87.6), (41.904 + n * 0.004, -87.6)), way((41.9 + n * 0.004, -87.6)))
                                  for t in range(3) for n, k in enumerate(["walk", "transit", "walk"])],
                                 "trip_id long, leg_no int, leg_type string, path array<struct<lat double, lon double>>, steps array<struct<lat double, lon double>>")
    want = sorted(tuple(x) for x in K.track_trips(spark.createDataFrame(pings, PING), legs).fillna(False).collect())
    last = [(2, FAR + dt.timedelta(days=i), 41.9, -87.6, False, False) for i in (1, 2)]
    out = J.to_table(J.stream_trips(shuffled(pings, PING, last, 5), legs, "2 days", in_order=True), "trips")
    assert sorted(tuple(x) for x in out.fillna(False).collect() if x.trip_id < 2) == want


def test_sessions_with_events(spark, shuffled):
    """Events set the stage of the session they fall into and neither open nor glue one."""
    visits = [visit(1, 0, "a"), visit(2, 3_000, "a", "/recommend"), visit(3, 0, "b"), visit(4, 1_800, "b"), visit(5, 3_601, "b")]
    events = [visit(10, 1_500, "a", "/x", "recommend_returned"), visit(11, 2_000, "a", "/x", "trip_completed"), visit(12, 4_000, "a", "/x", "app_loaded"),
              visit(13, 100, "c", "/x", "app_loaded"), visit(14, 3_600, "b", "/x", "route_selected"), visit(15, 3_601, "b", "/x", "nonsense")]
    out = J.stream_sessions(shuffled(visits, VISIT, closing(), 5), shuffled(events, VISIT, [], 3, 2), delay="1 day")
    got = sorted((x.sid, (x.start_us - min_us) // 10**6, (x.last_us - min_us) // 10**6, x.visits, x.recommends, x.stage)
                 for x in J.to_table(out, "sessions").collect() if x.sid != "zz")
    assert got == [("a", 0, 0, 1, 0, 2), ("a", 3_000, 3_000, 1, 1, 0), ("b", 0, 1_800, 2, 0, 3), ("b", 3_601, 3_601, 1, 0, -1)]


min_us = int((T0 - dt.datetime(1970, 1, 1)).total_seconds()) * 10**6


def test_sessions_equal_batch(spark, shuffled):
    r = random.Random(3)
    rows = [visit(i, r.randrange(0, 30_000), r.choice("ab"), r.choice(["/ping", "/recommend"])) for i in range(60)]
    want = sorted((x.sid, x.start_us, x.last_us, x.visits, x.recommends) for x in
                  A.sessionize(spark.createDataFrame(rows, VISIT)).select("sid", "start_us", "last_us", "visits", "recommends").collect())
    none = spark.createDataFrame([], VISIT)
    out = J.stream_sessions(shuffled(rows, VISIT, closing(), 4), shuffled([visit(99, 0, "q", "/x", "app_loaded")], VISIT, [], 1, 2), delay="1 day")
    assert none.count() == 0
    got = sorted((x.sid, x.start_us, x.last_us, x.visits, x.recommends) for x in J.to_table(out, "sessions").collect() if x.sid != "zz")
    assert got == want


def test_late_rows_are_counted_beyond_the_kept_reports(spark, shuffled, tmp_path):
    """More reports than a query keeps: every dropped row is in the table."""
    before = spark.conf.get("spark.sql.streaming.numRecentProgressUpdates")
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", "3")
    try:
        rows = [visit(i, 86_400 * (20 - i), "a") for i in range(8)]     # each a day older than the one before
        src = shuffled([], VISIT, rows, 0)
        table = str(tmp_path / "late")
        J.to_table(J.daily_visitors(src, "10 minutes"), "days", late=table)
        kept = spark.read.parquet(table).collect()
    finally:
        spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", before)
    assert max(x.reports for x in kept) > 3
    # The watermark stays a day and ten minutes behind the first visit's day: its own and the day before still count.
    assert sum(x.dropped for x in kept) == 6
