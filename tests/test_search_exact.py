"""The k-best search keeps every k-best itinerary, whatever its prefixes have visited."""

import itertools
import random

from headway.operators import itinerary as I

RIDES = "period string, route_id string, mode string, line string, board_id string, alight_id string, minutes double"
ENDS = "od_id long, stop_id string, walk_minutes double"
WALKS = "period string, from_id string, to_id string, minutes double"


def search(spark, access, egress, rides, walks, k, ods=(1,)):
    od = spark.createDataFrame([(i, "p") for i in ods], "od_id long, period string")
    rows = [("p", r, "rail", r, b, a, m) for r, b, a, m in rides]
    return I.itineraries(od, spark.createDataFrame(access, ENDS), spark.createDataFrame(egress, ENDS),
                         spark.createDataFrame(rows, RIDES), spark.createDataFrame([("p", *w) for w in walks], WALKS), k=k)


def brute(access, egress, rides, walks, k):
    """Every walk, ride, transfer sequence of up to three rides that visits no stop twice."""
    fast = {}
    for r, b, a, m in rides:
        fast[r, b, a] = min(m, fast.get((r, b, a), m))
    best = {}

    def go(stop, route, seen, sig, cost, n):
        for _, s, w in egress:
            if s == stop and (n or not sig):
                key = "|".join(sig)
                best[key] = min(best.get(key, 1e9), cost + w)
        if n == 3:
            return
        starts = [(stop, 0.0, seen)] if n == 0 else [(stop, 6.0, seen)] + [
            (t, w + 3.0, seen + [t]) for f, t, w in walks if f == stop and t not in seen]
        for at, extra, been in starts:
            for (r, b, a), m in fast.items():
                if b == at and r != route and a not in been:
                    go(a, r, been + [a], [*sig, f"{r}:{b}>{a}"], cost + extra + m, n + 1)

    for _, s, w in access:
        go(s, None, [s], [], w, 0)
    return [round(t, 6) for t in sorted(best.values())[:k]]


def test_prefixes_that_passed_the_exit(spark):
    rides = [("Q1", "A", "X", 1.0), ("R", "X", "S", 1.0), ("R", "X2", "S", 1.0), ("R", "Y", "S", 1.0), ("Q2", "A", "Y", 9.0),
             ("T", "S", "X", 1.0)]
    got = search(spark, [(1, "A", 0.0)], [(1, "X", 0.0)], rides, [("X", "X2", 1.0)], 2).orderBy("rank").collect()
    assert [r.signature for r in got] == ["Q1:A>X", "Q2:A>Y|R:Y>S|T:S>X"]


def test_random_networks(spark):
    r = random.Random(11)
    cases, rides, walks, want = [], [], [], {}
    for od in range(6):
        stops = [f"{od}{c}" for c in "ABCDEF"]
        mine = [(f"{od}L{i % 4}", b, a, float(r.randint(1, 12))) for i, (b, a) in enumerate(r.sample(list(itertools.permutations(stops, 2)), 14))]
        foot = [(b, a, float(r.randint(1, 5))) for b, a in r.sample(list(itertools.permutations(stops, 2)), 4)]
        access = [(od, s, float(r.randint(0, 4))) for s in stops[:2]]
        egress = [(od, s, float(r.randint(0, 4))) for s in stops[3:5]]
        cases.append((access, egress))
        rides += mine
        walks += foot
        want[od] = (access, egress, mine, foot)
    for k in (1, 3, 5):
        got = search(spark, [x for a, _ in cases for x in a], [x for _, e in cases for x in e], rides, walks, k, range(6)).collect()
        for od, (a, e, m, w) in want.items():
            totals = [round(x.total, 6) for x in sorted(got, key=lambda x: x["rank"]) if x.od_id == od]
            assert totals == brute(a, e, m, w, k)
