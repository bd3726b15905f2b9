"""Sessions with events are windows that Spark aggregates, exact to the microsecond at their ends."""

import datetime as dt

from headway.streaming import jobs as J

ROW = "ts timestamp_ntz, path string, sid string, event_name string"
T0 = dt.datetime(2024, 1, 10, 14, 0)
GAP = 60_000_000


def at(us):
    return T0 + dt.timedelta(microseconds=us)


def test_ends_are_exact(spark, tmp_path):
    visits = {"a": [0, GAP, 2 * GAP + 1], "b": [10, 10, 5 * GAP], "c": [7]}
    events = {"a": [(2 * GAP, 2), (2 * GAP + 1, 0)], "b": [(9, 5), (8, 4), (10, 1), (5 * GAP - 1, 3)], "c": [(7 + GAP, 4), (8 + GAP, 5), (9 + GAP, 5)], "d": [(3, 1)]}
    stages = [f"e{i}" for i in range(6)]

    def stream(rows, name):
        spark.createDataFrame(rows, ROW).coalesce(1).write.parquet(str(tmp_path / name))
        return spark.readStream.schema(ROW).parquet(str(tmp_path / name))

    v = stream([(at(t), "/ping", s, None) for s, ts in visits.items() for t in ts] + [(at(10**13), "/ping", "zz", None)], "visits")
    e = stream([(at(t), "/x", s, stages[i]) for s, ts in events.items() for t, i in ts], "events")
    out = J.stream_sessions(v, e, gap_seconds=60, delay="1 minute", stages=stages)
    assert "TransformWithState" not in out._jdf.queryExecution().logical().toString()
    zero = int((T0 - dt.datetime(1970, 1, 1)).total_seconds()) * 10**6
    got = sorted((x.sid, x.start_us - zero, x.last_us - zero, x.visits, x.stage) for x in J.to_table(out, "sessions").collect())
    assert got == [("a", 0, GAP, 2, 2), ("a", 2 * GAP + 1, 2 * GAP + 1, 1, 0), ("b", 10, 10, 2, 1), ("b", 5 * GAP, 5 * GAP, 1, -1), ("c", 7, 7, 1, 4)]
