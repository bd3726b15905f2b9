import hashlib
import hmac
import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from headway.functions import crowding, geo, text, timecode, weather, web
from headway.operators import places

L = F.lit


def ts(x):
    return L(x).cast("timestamp_ntz")


def test_times(one):
    assert one(timecode.gtfs_minutes(L("25:30:00")), timecode.gtfs_minutes(L("x:00:00")), timecode.gtfs_minutes(L("08:00")),
               timecode.clock_hhmm(L("24:15:00")), timecode.clock_hhmm(L("8:05"))) == (1530.0, None, None, "00:15", "08:05")


@pytest.mark.parametrize("when,want", [
    ("2024-01-10 08:00:00", "weekday_peak"), ("2024-01-10 17:00:00", "weekday_peak"), ("2024-01-10 12:00:00", "weekday_midday"),
    ("2024-01-10 20:30:00", "weekday_evening"), ("2024-01-13 13:00:00", "weekend"), ("2024-01-13 03:00:00", "owl"),
    ("2024-01-10 23:30:00", "owl"), ("2024-01-10 05:00:00", "weekday_midday")])
def test_service_period(one, when, want):
    assert one(timecode.service_period(ts(when))) == (want,)


def test_holidays(one):
    days = ["2024-07-04", "2024-06-15", "2024-05-27", "2024-05-20", "2024-09-02", "2024-11-28", "2024-11-21"]
    got = one(*[timecode.sunday_service_holiday(L(d).cast("date")) for d in days])
    assert got == (True, False, True, False, True, True, False)


def test_geo(one):
    d = geo.haversine(L(41.9), L(-87.6), L(41.9), L(-87.6))
    none = geo.haversine(L(None).cast("double"), L(-87.6), L(41.9), L(-87.6))
    ne = geo.heading8(L(41.0), L(-87.0), L(41.1), L(-86.87))
    seg = geo.point_segment_metres(L(41.001), L(-87.0), L(41.0), L(-87.001), L(41.0), L(-86.999))
    got = one(d, none, ne, F.round(seg, 0), geo.cardinal(geo.bearing(L(41.0), L(-87.0), L(40.0), L(-87.0))))
    assert got == (0.0, None, "NE", 111.0, "Southbound")


@pytest.mark.parametrize("raw,street,addr", [
    ("N Clark St", "clark", "clark"), ("Lake Shore Dr", "lake shore", "lake shore"), ("1234 N Clark St", "1234 n clark", "1234 clark"),
    ("22 W Washington", "22 w washington", "22 washington"), ("Street", "street", "street"), ("N", "n", ""), ("", "", "")])
def test_street_forms(one, raw, street, addr):
    assert one(text.street_name(L(raw)), text.address(L(raw))) == (street, addr)


def test_query_forms(one):
    cross = lambda q: text.cross_street(L(q))
    a, b, c, d, e = one(cross("Clark and Belmont"), cross("Belmont/Clark"), cross("corner of N Clark St & Belmont Ave"), cross("Clark"), cross("Clark at Clark"))
    assert tuple(a) == tuple(b) == tuple(c) == ("belmont", "clark") and d is None and e is None
    got = one(text.expand_suffixes(L("clark st, lake ave")), text.expand_suffixes(L("st james place")), text.title_case(L("o'hare mid-way")),
              text.query_tag(L("home")), text.coarse_coordinate(L(41.876), L(-87.631)))
    assert got == ("clark street, lake avenue", "st james place", "O'Hare Mid-Way",
                   "q#" + hashlib.sha256(b"home").hexdigest()[:10], "(41.88, -87.63)")
    assert tuple(one(text.coordinate_pair(L(" 41.9 , -87.6 ")))[0]) == (41.9, -87.6)


def test_fuzzy_equals_brute_force(spark):
    rng = random.Random(3)
    words = ["museum", "art", "history", "park", "river", "lincoln", "the", "of", "chicago", "northwest", "conservatory"]
    names = sorted({" ".join(rng.choices(words, k=rng.randint(1, 5))) for _ in range(150)})
    queries = set()
    for n in names:
        for _ in range(4):
            q = list(n)
            for _ in range(rng.randint(0, 2)):
                i = rng.randrange(len(q))
                q[i:i + 1] = rng.choice(["", "x", q[i] * 2])
            queries.add("".join(q))
    stop = set(text.STOP_WORDS)
    want = {}
    for q in queries:
        qw = set(q.split()) - stop
        best = max(((SequenceMatcher(None, n, q).ratio(), n) for n in names if len(qw) <= 1 or qw & set(n.split())), default=(0, ""))
        if best[0] >= 0.95:
            want[q] = round(best[0], 9)
    got = places.fuzzy_match(spark.createDataFrame([(q,) for q in queries], "query string"),
                             spark.createDataFrame([(n,) for n in names], "name string")).collect()
    assert {r["query"]: round(r["score"], 9) for r in got} == want and len(want) > 100


def test_hmac(spark):
    df = spark.createDataFrame([("salt2024-06-16", "10.0.0.1"), ("k" * 70, "x"), ("6\\6", "")], "k string, m string")
    for r in df.select("k", "m", web.hmac_sha256(F.col("k"), F.col("m")).alias("h"), web.hmac_sha256(b"fixed", F.col("m")).alias("s")).collect():
        assert r.h == hmac.new(r.k.encode(), r.m.encode(), hashlib.sha256).hexdigest()
        assert r.s == hmac.new(b"fixed", r.m.encode(), hashlib.sha256).hexdigest()


def test_web(one):
    ref = lambda u: web.referrer_bucket(web.url_host(L(u)), ["me.example"])
    got = one(ref("https://www.google.com/x"), ref("https://notgoogle.com"), ref("https://t.co/a"), ref("https://me.example/"), ref("garbage"),
              web.client_ip(L(""), L("1.1.1.1, 2.2.2.2"), L("3.3.3.3")), web.client_ip(L("9.9.9.9"), L(None), L(None)),
              web.device_bucket(L("Googlebot")), web.device_bucket(L("iPad")), web.device_bucket(L(None)),
              web.ipv4_number(L("1.0.0.2")), web.ipv4_number(L("1.0.0.256")), web.ipv4_number(L("1.2.3")))
    assert got == ("search", "other", "social", "direct", "direct", "2.2.2.2", "9.9.9.9", "bot", "tablet", "unknown", 16777218, None, None)


def test_weather(one):
    w = lambda t: (weather.precipitation_type(L(t)), weather.precipitation_intensity(L(t)))
    got = one(*w("Light Drizzle"), *w("Snow Flurries"), *w("Blizzard"), *w("Sleet"), *w("Sunny"),
              weather.wind_mph(L("5 to 10 mph")), weather.wind_mph(L("0 mph")), weather.wind_mph(L("calm")),
              weather.walk_factor(L("snow"), L("heavy"), L(40.0), L(-5.0)))
    assert got == ("rain", "light", "snow", "light", "snow", "heavy", "sleet", "moderate", "none", "", 7.5, 0.0, 0.0, 0.60)


def test_crowding(one):
    e = crowding.estimate(L("peak"), L("inbound"), L(8), L(5), L(10), L("40380"), L(""))
    live = crowding.estimate(L("peak"), L("inbound"), L(8), L(5), L(10), L("40380"), L("EMPTY"))
    a, b = one(e, live)
    assert tuple(a) == (1.0, "very_high", "medium") and tuple(b) == (0.10, "low", "high")
