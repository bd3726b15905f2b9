import json

from pyspark.sql import functions as F

from headway.operators import live as V
from headway.operators import places as L
from headway.sources import cache as C
from headway.sources import feeds as D


def train(spark, eta, err="0"):
    body = json.dumps({"ctatt": {"errCd": err, "errNm": "boom", "eta": eta}})
    return spark.createDataFrame([("40380", "Stn", body)], "station_id string, station_label string, body string").withColumn(
        "now", F.lit("2024-01-10 08:00:00").cast("timestamp_ntz"))


def test_train_arrivals(spark):
    one = {"rt": "Red", "arrT": "2024-01-10T08:04:40", "destNm": "Howard", "isApp": "1"}
    got = D.parse_train_arrivals(train(spark, one)).collect()
    assert [(r.line, r.minutes, r.station, r.is_approaching, r.is_delayed) for r in got] == [("Red Line", 5, "Stn", True, False)]
    many = [dict(one, arrT="20240110 07:59:00"), dict(one, arrT="2024-01-10T14:10:00+00:00", rt="Zz"), dict(one, arrT="soon"), {"rt": "Red"}]
    assert sorted((r.line, r.minutes) for r in D.parse_train_arrivals(train(spark, many)).collect()) == [("Red Line", 0), ("Zz", 10)]
    assert D.parse_train_arrivals(train(spark, one, "101")).count() == 0
    assert [(r.code, r.message) for r in D.train_errors(train(spark, one, "101")).collect()] == [("101", "boom")]


def test_bus_predictions(spark):
    prd = [{"rt": "22", "stpid": "1", "prdctdn": "DUE", "rtdir": "Northbound", "psgld": None, "dly": True},
           {"rt": "22", "stpid": "1", "prdctdn": None, "psgld": "Half Empty", "dly": "yes"}, {"rt": "9", "prdctdn": "7", "dly": "no"}]
    df = spark.createDataFrame([(json.dumps({"bustime-response": {"prd": prd}}),), (json.dumps({"bustime-response": {"prd": prd[2]}}),), ("{}",)], "body string")
    got = sorted((r.line_code, r.minutes, r.direction, r.load, r.is_delayed) for r in D.parse_bus_predictions(df).collect())
    assert got == [("22", 0, "", "HALF_EMPTY", True), ("22", 0, "northbound", "", True), ("9", 7, "", "", False), ("9", 7, "", "", False)]


def test_alerts(spark):
    a = lambda i, s, svc: {"AlertId": i, "SeverityScore": s, "EventEnd": "", "ImpactedService": {"Service": svc}}
    doc = {"CTAAlerts": {"Alert": [a("1", "70", {"ServiceId": "red"}), a("2", "69", [{"ServiceId": "22"}, {"ServiceId": ""}]), a("3", "x", [])]}}
    df = spark.createDataFrame([(1, json.dumps(doc)), (2, json.dumps({"CTAAlerts": {"Alert": a("1", "10", [])}}))], "seq int, body string")
    al = D.parse_alerts_json(df)
    assert sorted((r.seq, r.alert_id, r.is_major, r.affected_routes, r.event_end) for r in al.collect()) == [
        (1, "1", True, ["red"], None), (1, "2", False, ["22"], None), (2, "1", False, [], None)]
    assert [(r.alert_id, r.severity) for r in V.dedupe_alerts(al).collect()] == [("1", 70), ("2", 69)]
    xml = "<A><Alert><AlertId>5</AlertId><SeverityScore>40</SeverityScore><ImpactedService><Service><ServiceName>Red Line</ServiceName></Service></ImpactedService></Alert><Alert><AlertId>6</AlertId></Alert></A>"
    got = D.parse_alerts_xml(spark.createDataFrame([(xml,)], "body string")).collect()
    assert [(r.alert_id, r.severity_class, r.routes) for r in got] == [("5", "Minor", ["Red"]), ("6", "Planned", [])]


def test_board_keeps_empty_pins(spark):
    arr = spark.createDataFrame([("bus", "1", "22", "N", m) for m in (9, 3, 5, 7)], "mode string, stop_id string, line_code string, destination string, minutes int")
    pins = spark.createDataFrame([("bus", "1"), ("train", "40001"), ("boat", "1")], "mode string, stop_id string")
    got = {r.key: [a.minutes for a in r.arrivals] for r in V.stop_board(arr, pins).collect()}
    assert got == {"bus:1": [3, 5, 7], "train:40001": []}


def test_wait_follows_the_direction(spark):
    places = spark.createDataFrame([("A", 41.90, -87.6), ("N", 41.95, -87.6), ("E", 41.90, -87.5)], "stop_id string, lat double, lon double")
    terms = spark.createDataFrame([("north", 42.0, -87.6), ("south", 41.7, -87.6)], "terminal string, lat double, lon double")
    arr = spark.createDataFrame([(1, "Red", "A", "North", 9), (1, "Red", "A", "South", 2)], "walk_id int, line_code string, stop_id string, destination string, minutes int")
    legs = spark.createDataFrame([(1, 1, "Red", "A", "N", "N"), (2, 1, "Red", "A", "E", "E"), (3, 1, "Red", "A", "?", "?")],
                                 "leg_id int, walk_id int, line_code string, from_id string, to_id string, final_id string")
    got = {r.leg_id: r.wait for r in V.pick_wait(legs, arr, places, terms).collect()}
    assert got[1] == 9 and got[3] == 2


def test_suggestions_drop_shared_places_and_labels(spark):
    rows = [{"tier": "a", "label": "X", "lat": 1.0, "lon": 1.0}, {"tier": "b", "label": "Y", "lat": 1.0, "lon": 1.0},
            {"tier": "a", "label": "x", "lat": 2.0, "lon": 2.0}, {"tier": "b", "label": "x", "lat": 2.0, "lon": 2.0}]
    df = spark.createDataFrame([(rows,)], "items array<struct<tier string, label string, lat double, lon double>>")
    got = df.select(L.dedupe_two_keys(F.col("items")).alias("k")).first().k
    assert [(x.tier, x.label) for x in got] == [("a", "X"), ("b", "x")]


def test_cache_replay(spark):
    snap = spark.createDataFrame([("A St", "[1.0, 2.0]", 1), ("b", "null", 2), ("c", '["x"]', 3)], "key string, value string, seq long")
    jour = spark.createDataFrame([("b", "[3.0, 4.0]", 1), ("a street", "null", 2)], "key string, value string, seq long")
    ages = spark.createDataFrame([("b", 100.0)], "key string, recorded_at double")
    now = 100 * C.DAY
    got = {r["query"]: (r.lat, r.fetched_at, r.collisions) for r in C.replay_cache(snap, jour, ages, now).collect()}
    assert got == {"a street": (None, now - C.DEFAULT_AGE, 1), "b": (3.0, now - C.MAX_AGE, 0)}
    kept, seen = C.evict_older_than(C.replay_cache(snap, jour, ages, now), 45, now)
    assert [r["query"] for r in kept.collect()] == ["a street"] and seen.get["deleted"] == 1


def test_forecast_turn(spark):
    df = spark.createDataFrame([("none", ["rain", "none", "snow"]), ("rain", ["none", "rain", "none"]), ("none", ["rain"])], "now string, next array<string>")
    assert [r[0] for r in df.select(V.forecast_turn(F.col("now"), F.col("next"))).collect()] == [
        "(forecast: snow starts in ~3h)", "(forecast: clears in ~3h)", ""]
