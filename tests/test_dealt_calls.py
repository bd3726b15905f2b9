"""Timetable calls stay dealt over many tasks, and what is made from them equals brute force."""

import pytest
from pyspark.sql import functions as F

from headway.operators import schedule as G

TIMES = [(f"t{i}", f"{100 + i % 7}", i // 5 % 9, f"{i % 24:02d}:{i % 60:02d}", None if i % 3 else f"via {i % 4}") for i in range(2000)] + [
    ("t7", "100", None, "07:07", ""), (None, "100", 1, "07:07", "x"), ("t8", "100", 1, None, "x"), ("t9", "100", 2, "09:09", "x"), ("t9", "100", 2, "09:09", "x")]
TRIPS = [(f"t{i}", f"R{i % 3}", str(i % 2), f"S{i % 4}", "" if i % 5 == 0 else f"To {i % 6}") for i in range(1990)] + [
    ("t9", "R7", "0", "S1", "To 9"), (None, "R8", "0", "S1", "To 8")]
BUCKETS = [("S0", "weekday"), ("S1", "weekday"), ("S1", "sunday"), ("S2", "sunday")]


@pytest.fixture(params=["-1", "10485760"])
def calls(spark, request):
    """The calls with trips merged, as large ones are, and broadcast, as small ones are."""
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", request.param)
    yield G.timetable_calls(spark.createDataFrame(TIMES, "trip_id string, stop_id string, seq int, hhmm string, headsign string"),
                            spark.createDataFrame(TRIPS, "trip_id string, route_id string, direction_id string, service_id string, headsign string"),
                            spark.createDataFrame(BUCKETS, "service_id string, bucket string"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


def joined():
    return [(r, d, b, s, q or 0, t, h, sign, trip_sign) for t, s, q, h, sign in TIMES for u, r, d, v, trip_sign in TRIPS
            for w, b in BUCKETS if t is not None and t == u and h is not None and v == w]


@pytest.mark.parametrize("calls", ["-1"], indirect=True)
def test_no_task_gets_a_large_share_of_the_calls(calls):
    shares = [r["count"] for r in calls.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(shares) == len(joined()) and max(shares) * 8 <= sum(shares)


def test_headsigns_of_dealt_calls(calls):
    first = {}
    for r, d, _, _, q, t, _, sign, trip_sign in joined():
        name = sign if sign is not None else trip_sign or None
        if name is not None:
            first[r, d] = min(first.get((r, d), (t, q, name)), (t, q, name))
    assert {(x.route_id, x.direction_id): x.headsign for x in G.headsigns(calls).collect()} == {k: v[2] for k, v in first.items()}


def test_timetable_by_hour_of_dealt_calls(calls):
    want = {}
    for r, d, b, s, _, _, h, _, _ in joined():
        if b == "sunday":
            want.setdefault((r, d, s, int(h[:2])), set()).add(h[3:])
    got = G.timetable_by_hour(calls, F.lit("2024-07-04").cast("date")).collect()
    assert {(x.route_id, x.direction_id, x.stop_id, x.hour): x.minutes for x in got} == {k: sorted(v) for k, v in want.items()} and len(got) == len(want)
