"""Computed columns are worked out once per row, and only the calls of chosen trips are joined again."""

from pyspark.sql import functions as F

from headway.operators.schedule import trip_heads
from headway.plans.feed import Feed
from headway.sources.gtfs import FEED_COLUMNS, coerce


def feed(spark, stop_times, trips=(("R1", "S", "t1", "0", "", "To A"),)):
    """A feed with one bus route and one stop; its stop times come out of a computation, as adapters make them."""
    rows = {
        "stops": [("100", "A & B", "41.9", "-87.6", "0", "")], "routes": [("R1", "1", "Route 1", "3", "ffffff")],
        "trips": list(trips), "calendar": [("S", *"1111100", "20240101", "20241231")],
    }
    raw = {n: spark.createDataFrame(rows.get(n, []), ", ".join(f"{c} string" for c in cols))
           for n, cols in FEED_COLUMNS.items() if n != "stop_times"}
    st = spark.createDataFrame(stop_times, ", ".join(f"{c} string" for c in FEED_COLUMNS["stop_times"]))
    raw["stop_times"] = st.withColumn("departure_time", F.concat(F.lpad(F.split("departure_time", ":")[0], 2, "0"), F.lit(":"),
                                                                 F.substring_index("departure_time", ":", -2)))
    return raw


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_clock_texts_are_parsed_once_per_row(spark):
    good, _ = coerce(feed(spark, [("t1", "08:00:00", "08:00:00", "100", "1", "")]))
    f = Feed(good)
    assert plan(trip_heads(f.calls)).count("lpad") == 3       # one of the source, two of the clock time


def test_clock_texts_keep_their_meaning(spark):
    times = [("t1", a, d, "100", str(i), "") for i, (a, d) in enumerate([
        ("08:00:00", "08:01:00"), ("", "9:02:00"), (None, "24:15:00"), ("x", "08:05:00"), ("x", "y:0:0"), ("10:00", "10:00:30")])]
    good, bad = coerce(feed(spark, times))
    rows = {r.seq: (r.arr_min, r.dep_min, r.dep_text, r.hhmm) for r in good["stop_times"].collect()}
    assert rows[0] == (480.0, 481.0, "08:01:00", "08:01")
    assert rows[1] == (542.0, 542.0, "09:02:00", "09:02")
    assert rows[2] == (1455.0, 1455.0, "24:15:00", "00:15")
    assert rows[3] == (None, 485.0, "08:05:00", "08:05")
    assert rows[5] == (None, 600.5, "10:00:30", "10:00")
    assert 4 not in rows and bad["stop_times"].columns == FEED_COLUMNS["stop_times"] and bad["stop_times"].count() == 1
    assert bad["stops"].columns == FEED_COLUMNS["stops"]


def test_stops_of_chosen_trips_equal_all_calls_cut_to_them(spark):
    trips = [("R1", "S", f"t{i}", "0", "", "To A") for i in range(4)]
    times = [(f"t{i}", f"{7 + i:02d}:{10 * j:02d}:00", f"{7 + i:02d}:{10 * j:02d}:00", "100", str(j), "")
             for i in range(4) for j in range(3)]
    f = Feed(coerce(feed(spark, times, trips))[0])
    got = {(r.period, r.trip_id, r.pos) for r in f.rep_stops.collect()}
    want = {(p.period, r.trip_id, r.pos) for p in f.reps.collect() for r in f.sequences.collect() if r.trip_id == p.trip_id}
    assert got == want and got
    assert len({t for _, t, _ in got}) < 4
