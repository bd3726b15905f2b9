import pytest
from pyspark.sql import functions as F

from headway.operators import network as N
from headway.operators import schedule as G
from headway.plans.feed import Feed
from headway.sources import gtfs, sinks

FILES = {
    "stops": "﻿stop_id,stop_name,stop_lat,stop_lon,location_type,parent_station\n"
             "1001,Howard,42.019,-87.672,0,\n1002,Loyola,42.001,-87.661,0,\n1003,Belmont,41.94,-87.653,0,\n"
             "40001,Stn A,41.9,-87.6,1,\n40002,Stn B,41.95,-87.6,1,\n40003,Stn C,41.99,-87.6,1,\n30001,Plat A,41.9,-87.6,0,40001\n30002,Plat B,41.95,-87.6,0,40002\n"
             "30009,Orphan,41.9,-87.6,0,\nabc,Bad,1,1,0,\n1004,Bad,x,1,0,\n",
    "routes": "route_id,route_short_name,route_long_name,route_type,route_color\n Red ,,Red,1,C60C30\n22,22,Clark,3,B71234\n,9,None,3,\n",
    "trips": "route_id,service_id,trip_id,direction_id,shape_id,trip_headsign\nRed,WD,r1,0,,Howard\nRed,SA,r2,0,,Howard\nRed,SU,r3,0,,Howard\nRed,WD,r4,,,Howard\n22,NONE,b1,0,,North\n22,WD,,0,,\nX,WD,u1,0,,\n",
    "stop_times": "trip_id,arrival_time,departure_time,stop_id,stop_sequence,stop_headsign\n"
                  "r1,08:10:00,08:10:00,30002,2,\nr1,,08:00:00,30001,1,\nr1,08:20:00,08:20:00,40003,3,\nr2,09:00:00,09:00:00,30001,1,\nr3,24:15:00,24:15:00,30001,1,\n"
                  "r4,25:30:00,25:30:00,30001,1,\nr4,bad,bad,30002,2,\nb1,07:00:00,07:00:00,1001,1,\n",
    "calendar": "service_id,monday,tuesday,wednesday,thursday,friday,saturday,sunday,start_date,end_date\nWD,1,1,1,1,1,0,0,20240101,20240601\nSA,0,0,0,0,0,1,0,20240101,20241231\nM4,1,1,1,1,0,0,0,20240201,20240301\n",
    "calendar_dates": "service_id,date,exception_type\nSU,20240704,1\nSU,20240615,1\nTW,20240109,1\nTW,20240116,1\nTH,20240104,1\nTH,20240111,1\nTH,20240118,1\nWD,20240110,2\n",
    "transfers": "from_stop_id,to_stop_id,transfer_type,min_transfer_time\n30001,40002,2,45\n40001,40001,2,300\n40002,40003,2,300\n40001,99999,2,60\n",
}


@pytest.fixture(scope="module")
def feed(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("feed")
    for name, body in FILES.items():
        (d / f"{name}.txt").write_text(body, encoding="utf-8")
    return Feed.from_folder(spark, str(d))


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_reader_keeps_good_rows_and_rejects_the_rest(spark, feed, tmp_path):
    assert feed.tables["stops"].count() == 9 and feed.tables["shapes"].count() == 0
    assert rows(feed.tables["routes"], "route_id") == [("22",), ("Red",)]
    for name, body in FILES.items():
        (tmp_path / f"{name}.txt").write_text(body, encoding="utf-8")
    bad = gtfs.coerce(gtfs.read_raw(spark, str(tmp_path)))[1]
    assert bad["stops"].count() == 2 and bad["stop_times"].count() == 1 and bad["trips"].count() == 1


def test_kinds_and_routes(feed):
    assert dict(rows(feed.stops.groupBy("kind").count(), "kind", "count")) == {"station": 3, "platform": 2, "bus": 3}
    assert rows(feed.routes, "route_id", "short_name", "long_name", "mode", "category") == [
        ("22", "22", "Clark", "bus", "bus_express"), ("Red", "Red", "Red Line", "rail", "train")]


def test_sequences(feed):
    got = rows(feed.sequences.where("trip_id = 'r1'"), "pos", "stop_id", "arr_min", "first_min", "n_stops")
    assert got == [(0, "40001", 480.0, 480.0, 3), (1, "40002", 490.0, 480.0, 3), (2, "40003", 500.0, 480.0, 3)]


def test_calendar(feed):
    assert rows(feed.buckets, "service_id", "bucket") == [("SA", "saturday"), ("SU", "sunday"), ("WD", "weekday")]
    days = set(rows(feed.days, "service_id", "dow"))
    assert ("TH", 3) in days and not any(s in ("TW", "SU") for s, _ in days) and ("M4", 3) in days and ("M4", 4) not in days
    w = G.feed_window(feed.tables["calendar"]).first()
    assert (str(w.start_date), str(w.end_date)) == ("2024-01-01", "2024-12-31")


def test_timetable_and_last_departure(feed, tmp_path):
    t = {(r.stop_id, r.bucket): r.times for r in G.timetable(feed.timetable_calls).collect()}
    assert t[("30001", "weekday")] == ["01:30", "08:00"] and t[("30001", "saturday")] == ["09:00"] and t[("30001", "sunday")] == ["00:15"]
    docs = G.timetable_documents(feed.timetable_calls, feed.routes, feed.tables["stops"].select("stop_id", "name", "lat", "lon"))
    assert [r.route_id for r in docs.collect()] == ["Red"]
    sinks.write_timetables(docs, str(tmp_path))
    back = feed.stops.sparkSession.read.json(str(tmp_path / "routes")).first()
    assert [s.stop_id for s in back.directions[0].stops] == ["30001", "30002", "40003"] and back.directions[0].headsign == "Howard"
    last = G.last_departures(feed.calls)
    assert rows(last.where("stop_id = '40001'"), "dep_text") == [("25:30:00",)]
    at = lambda t: G.until_last(last, F.lit(t).cast("timestamp_ntz")).where("stop_id = '40001'").first()
    assert (at("2024-01-10 01:00:00").minutes_until, at("2024-01-10 02:00:00").departed, at("2024-01-10 23:00:00").time) == (30, True, "01:30")


def test_trip_periods(feed):
    got = set(rows(feed.periods, "trip_id", "period"))
    assert {("r1", "weekday_peak"), ("r2", "weekend"), ("r4", "owl")} <= got and ("r4", "weekend") not in got


def test_transfers_are_floored_and_mutual(feed):
    got = rows(N.transfer_edges(feed.tables["transfers"], feed.stops), "from_id", "to_id", "minutes")
    assert got == [("40001", "40002", 3.0), ("40002", "40001", 3.0), ("40002", "40003", 5.0), ("40003", "40002", 5.0)]
    e = N.network_edges(feed.rep_stops, feed.stops, feed.tables["transfers"]).where("period = 'weekday_peak'")
    assert rows(e.where("from_id = '40001'"), "to_id", "edge_type", "minutes") == [("40002", "transit", 10.0)]


def test_upsert_replaces_only_its_days(spark, tmp_path):
    p = str(tmp_path / "daily")
    mk = lambda r: spark.createDataFrame(r, "date string, n int")
    sinks.upsert_daily(mk([("2024-01-01", 1), ("2024-01-02", 2)]), p)
    sinks.upsert_daily(mk([("2024-01-02", 9)]), p)
    assert rows(spark.read.parquet(p).select("n"), "n") == [(1,), (9,)]


def test_no_call_is_lost(spark):
    """Repeated sequence numbers, an unreadable departure and a blank number each keep their row where it can serve."""
    from headway.operators import schedule as S
    from headway.sources import gtfs

    cols = gtfs.FEED_COLUMNS["stop_times"]
    rows = [{"trip_id": "t", "arrival_time": a, "departure_time": d, "stop_id": s, "stop_sequence": n}
            for a, d, s, n in [("08:00:00", "08:00:00", "40001", "1"), ("08:05:00", "08:05:00", "40002", "1"),
                               ("08:10:00", "late", "40003", "2"), ("08:15:00", "08:15:00", "40004", ""), ("", "x", "40005", "3")]]
    raw = {n: spark.createDataFrame([], ", ".join(f"{c} string" for c in cs)) for n, cs in gtfs.FEED_COLUMNS.items()}
    raw["stop_times"] = spark.createDataFrame([[r.get(c, "") for c in cols] for r in rows], ", ".join(f"{c} string" for c in cols))
    good, bad = gtfs.coerce(raw)
    st = {r.stop_id: r for r in good["stop_times"].collect()}
    assert sorted(st) == ["40001", "40002", "40003", "40004"] and bad["stop_times"].count() == 1
    assert st["40003"].dep_min == 490 and st["40003"].hhmm is None and st["40004"].seq is None
    trips = spark.createDataFrame([("t", "r", "0", "s", None)], "trip_id string, route_id string, direction_id string, service_id string, headsign string")
    routes = spark.createDataFrame([("r", "rail")], "route_id string, mode string")
    stops = spark.createDataFrame([], "stop_id string, kind string, parent_id string")
    got = S.trip_stops(S.trip_calls(good["stop_times"], trips, routes, stops)).orderBy("pos").collect()
    assert [(r.stop_id, r.n_stops) for r in got] == [("40001", 3), ("40002", 3), ("40003", 3)]
