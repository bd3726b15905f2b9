import heapq
import math
import random

from pyspark.sql import functions as F

from headway.operators import itinerary as I
from headway.operators import spatial as P
from headway.operators import streets as R
from headway.operators import tracking as K
from headway.sources import osm
from headway.streaming import jobs as J


def hav(a, b, c, d, r=3958.8):
    p, q = math.radians(a), math.radians(c)
    x = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(d - b) / 2) ** 2
    return 2 * r * math.asin(math.sqrt(x))


def test_radius_join_equals_cross_join(spark):
    rng = random.Random(4)
    for lat0 in (41.9, -63.0, 0.0):
        a = [(i, lat0 + rng.uniform(-0.05, 0.05), rng.uniform(-0.05, 0.05)) for i in range(150)]
        b = [(i, lat0 + rng.uniform(-0.05, 0.05), rng.uniform(-0.05, 0.05)) for i in range(150)] + [(999, a[0][1], a[0][2])]
        got = {(r.a, r.b) for r in P.radius_join(spark.createDataFrame(a, "a int, lat double, lon double"),
                                                 spark.createDataFrame(b, "b int, lat double, lon double"), 1.3).collect()}
        assert got == {(x[0], y[0]) for x in a for y in b if hav(x[1], x[2], y[1], y[2]) <= 1.3}


def test_rings_stop_at_the_first_hit(spark):
    pts = spark.createDataFrame([(1, 41.9, -87.6), (2, 41.9, -87.6), (3, 45.0, -87.6)], "pid int, lat double, lon double")
    stops = spark.createDataFrame([(f"s{i}", 41.9 + m / 69.09, -87.6) for i, m in enumerate([0.6, 0.7, 0.74, 0.9])], "stop_id string, lat double, lon double")
    got = sorted((r.pid, r.stop_id, r.ring) for r in P.ring_nearest(pts, stops, P.RAIL_RINGS, 2).collect())
    assert got == [(p, s, 0.75) for p in (1, 2) for s in ("s0", "s1")]


def way(*pts):
    return [{"lat": a, "lon": b} for a, b in pts]


def test_crossings(spark):
    w = spark.createDataFrame([
        (1, "N Clark St", way((0.0, 0.0), (0.0, 0.02))), (2, "Clark Ave", way((-0.01, 0.005), (0.01, 0.005))),
        (3, "Belmont", way((-0.01, 0.004), (0.01, 0.004), (0.01, 0.012), (-0.01, 0.012))), (4, "Same", way((0.0, 0.001), (0.0, 0.003))),
        (5, "", way((-1.0, 0.01), (1.0, 0.01)))], "way_id int, name string, geometry array<struct<lat double, lon double>>")
    got = sorted((r.name_a, r.name_b, r.lat_q, r.lon_q) for r in P.crossing_streets(w).collect())
    assert got == [("belmont", "clark", 0, 400), ("belmont", "clark", 0, 1200), ("belmont", "clark", 1000, 500)]


def test_osm_addresses(spark):
    doc = """{"elements": [{"type":"node","id":1,"lat":41.9,"lon":-87.6,"tags":{"addr:housenumber":"12","addr:street":"N Clark St"}},
      {"type":"way","id":2,"center":{"lat":41.8,"lon":-87.7},"tags":{"addr:housenumber":"7","addr:street":"Oak"}}, {"type":"node","id":3,"lat":1.0,"lon":1.0,"tags":{"addr:street":"x"}},
      {"type":"way","id":4,"tags":{"name":"Elm"},"geometry":[{"lat":1.0,"lon":1.0},{"lat":1.0,"lon":2.0}]}]}"""
    el = osm.parse_elements(spark.createDataFrame([(doc,)], "value string"))
    assert sorted((r.id, r.normalized, r.lat) for r in osm.addresses(el).collect()) == [(1, "12 clark", 41.9), (2, "7 oak", 41.8)]
    assert osm.ways(el).count() == 1


def grid(n, rng):
    return [(i * n + j, k, rng.uniform(50, 200)) for i in range(n) for j in range(n)
            for k in ([i * n + j + 1] if j + 1 < n else []) + ([(i + 1) * n + j] if i + 1 < n else [])]


def test_street_distances_equal_dijkstra(spark):
    e = grid(8, random.Random(6))
    adj = {}
    for u, v, w in e:
        adj.setdefault(u, []).append((v, w))
        adj.setdefault(v, []).append((u, w))
    want = {}
    for s in (0, 27):
        heap, seen = [(0.0, s)], {}
        while heap:
            d, x = heapq.heappop(heap)
            if x in seen or d > 0.4 * 1609.344:
                continue
            seen[x] = d
            for y, w in adj[x]:
                heapq.heappush(heap, (d + w, y))
        want.update({(s, x): round(d, 6) for x, d in seen.items()})
    got = R.street_distances(spark.createDataFrame([(0, 0), (27, 27)], "source int, node int"), spark.createDataFrame(e, "u int, v int, length double"), 0.4)
    assert {(r.source, r.node): round(r.metres, 6) for r in got.collect()} == want


def test_components_and_hub(spark):
    e = [(0, i) for i in range(1, 200)] + [(300, 301), (301, 302), (400, 400)]
    got = {r.node: r.component for r in R.components(spark.createDataFrame(e, "u int, v int")).collect()}
    assert {got[i] for i in range(200)} == {0} and got[302] == 300 and got[400] == 400


def test_consolidation_is_transitive(spark):
    step = 8 / 111_195
    n = [(i, 41.9 + i * step, -87.6) for i in range(4)] + [(9, 41.95, -87.6), (10, 41.95, -87.6)]
    nodes = spark.createDataFrame(n, "node int, lat double, lon double")
    edges = spark.createDataFrame([(0, 1, 5.0), (3, 9, 50.0)], "u int, v int, length double")
    merged, rebuilt = R.consolidate_nodes(nodes, edges)
    assert sorted((r.node, r.merged) for r in merged.collect()) == [(0, 4), (9, 2)]
    assert [(r.u, r.v) for r in rebuilt.collect()] == [(0, 9)]


def test_street_walks_fall_back_to_straight_lines(spark):
    nodes = spark.createDataFrame([(1, 41.90, -87.60), (2, 41.91, -87.60), (3, 41.92, -87.70)], "node int, lat double, lon double")
    edges = spark.createDataFrame([(1, 2, 1500.0)], "u int, v int, length double")
    od = spark.createDataFrame([(1, 41.90, -87.60, 41.91, -87.60), (2, 41.90, -87.60, 41.92, -87.70), (3, 41.90, -87.60, 42.2, -87.60)],
                               "od_id int, o_lat double, o_lon double, d_lat double, d_lon double")
    got = {r.od_id: (r.on_streets, r.minutes) for r in R.street_walks(od, nodes, edges, 6.0).collect()}
    assert got[1] == (True, round(1500 / (3 * 1609.34 / 3600) / 60, 1)) and not got[2][0] and not got[3][0]
    assert got[3][1] == round(hav(41.9, -87.6, 42.2, -87.6) / 3 * 60, 1)


def path(spark, *edges):
    cols = "path_id int, edge_no int, from_id string, to_id string, edge_type string, mode string, route_id string, line string, minutes double, " \
           "all_routes array<struct<route_id string, direction_id string, line string>>"
    return spark.createDataFrame([(1, i, *e) for i, e in enumerate(edges)], cols)


def test_legs_merge_change_and_share_track(spark):
    t = lambda a, b, r, m, alls=None: (a, b, "transit", "rail", r, r, m, alls)
    both = [("Red", "0", "Red"), ("Brn", "0", "Brn")]
    p = path(spark, ("o", "A", "walk", "walk", None, None, 4.0, None), t("A", "B", "Brn", 2.0), t("B", "C", "Red", 3.0, both), t("C", "D", "G", 5.0),
             ("D", "E", "transfer", "walk", None, None, 3.0, None), t("E", "F", "Red", 1.0))
    got = [(r.leg_type, r.route_id, r.from_id, r.to_id, r.minutes) for r in I.legs_from_path(p).orderBy("leg_no").collect()]
    assert got == [("walk", None, "o", "A", 4.0), ("transit", "Brn", "A", "C", 5.0), ("walk", None, "C", "C", 3.0), ("transit", "G", "C", "D", 5.0),
                   ("walk", None, "D", "E", 3.0), ("transit", "Red", "E", "F", 1.0)]


def test_trip_tracking_batch_equals_stream(spark, tmp_path):
    import datetime as dt

    rng = random.Random(8)
    t0 = dt.datetime(2024, 1, 1)
    pings = spark.createDataFrame([
        (rng.randrange(3), t0 + dt.timedelta(minutes=i), 41.9 + rng.uniform(0, 0.012), -87.6, rng.random() < 0.3, rng.random() < 0.1)
        for i in range(120)], "trip_id long, ts timestamp_ntz, lat double, lon double, on_vehicle boolean, rerouted boolean")
    legs = spark.createDataFrame([(t, n, k, way((41.9 + n * 0.004, -87.6), (41.904 + n * 0.004, -87.6)), way((41.9 + n * 0.004, -87.6)))
                                  for t in range(3) for n, k in enumerate(["walk", "transit", "walk"])],
                                 "trip_id long, leg_no int, leg_type string, path array<struct<lat double, lon double>>, steps array<struct<lat double, lon double>>")
    batch = sorted(tuple(r) for r in K.track_trips(pings, legs).fillna(False).collect())
    pings.write.parquet(str(tmp_path / "p"))
    st = J.stream_trips(spark.readStream.schema(pings.schema).parquet(str(tmp_path / "p")), legs, "1 day")
    assert sorted(tuple(r) for r in J.to_table(st, "t").fillna(False).collect()) == batch
    assert {r[2] for r in batch} == {0, 1, 2}


def test_dedupe_by_line(spark):
    c = spark.createDataFrame([(1, "a", 1.0), (1, "b", 2.0), (1, "c", 3.0), (1, "d", 4.0)], "od_id int, stop_id string, walk_minutes double")
    lines = spark.createDataFrame([("a", "Red"), ("b", "Red"), ("c", "Red"), ("c", "Brn")], "stop_id string, line string")
    assert sorted(r.stop_id for r in I.dedupe_by_line(c, lines).collect()) == ["a", "c", "d"]


def test_ranking_uses_live_waits(spark):
    cols = f"od_id int, signature string, transfers int, transit_minutes double, walk_minutes double, total double, legs array<{I.LEG}>"
    walk = [("walk", "walk", None, None, "origin", "s", 4.0)]
    it = spark.createDataFrame([(1, "x", 1, 20.0, 8.0, 0.0, walk), (1, "y", 0, 30.0, 4.0, 0.0, walk)], cols)
    w = spark.createDataFrame([(1, "x", 6.0, [None]), (1, "y", None, None)], "od_id int, signature string, first_wait double, transfer_waits array<int>")
    got = [(r.signature, r.total) for r in I.rank_itineraries(it, w).orderBy("rank").collect()]
    assert got == [("x", 33.0), ("y", 34.0)]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_spread_side_of_cells_is_never_broadcast(spark):
    pts = spark.createDataFrame([(1, 41.9, -87.6)], "pid int, lat double, lon double")
    stops = spark.createDataFrame([(1, 41.9, -87.6)], "stop_id int, lat double, lon double")
    for df in (P.nearest_within(pts, stops, 0.5, "stop_id"), P.radius_join(pts, stops, 0.5), P.ring_nearest(pts, stops, P.RAIL_RINGS, 2)):
        joins = [line for line in plan_of(df).splitlines() if "Join" in line and "_row" in line]
        assert joins and all("SortMergeJoin" in line for line in joins)


def test_copies_of_a_place_meet_as_bundles(spark, monkeypatch):
    monkeypatch.setattr(P, "BUNDLE", 3)
    a = spark.createDataFrame([(i, 41.9, -87.6) for i in range(7)] + [(90, None, -87.6)], "a int, lat double, lon double")
    b = spark.createDataFrame([(i, 41.9, -87.601) for i in range(5)] + [(5, 42.4, -87.6)], "b int, lat double, lon double")
    pairs = P.radius_join(a, b, 0.5)
    assert "explode(_b" in plan_of(pairs)
    assert sorted((r.a, r.b) for r in pairs.collect()) == [(i, j) for i in range(7) for j in range(5)]
    assert pairs.columns == ["a", "lat", "lon", "b", "b_lat", "b_lon", "miles"]


def test_only_the_least_stops_of_a_place_enter_the_rings(spark):
    pts = spark.createDataFrame([(1, 41.9, -87.6), (2, 41.9, -87.6)], "pid int, lat double, lon double")
    stops = spark.createDataFrame([(i, 41.9, -87.601) for i in range(9)] + [(20, 41.9, -87.6)], "stop_id int, lat double, lon double")
    near = P.ring_nearest(pts, stops, P.bus_rings(), 3)
    assert "_n" in plan_of(near)
    assert sorted((r.pid, r["rank"], r.stop_id) for r in near.collect()) == [(p, n + 1, s) for p in (1, 2) for n, s in enumerate((20, 0, 1))]
