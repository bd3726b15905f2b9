"""Joins that grew faster than their input, against brute force."""

import random

import pytest

from headway.operators import itinerary as I
from headway.operators import live as V
from headway.operators import streets as R
from headway.operators import walks as W


def test_alerts_of_itineraries_that_ride_the_same_lines(spark):
    legs = spark.createDataFrame(
        [(o, 0, "transit", line) for o in range(6) for line in ("Red", "22")] + [(1, 0, "transit", "Red"), (7, 0, "walk", "Red"), (8, 1, "transit", "9"),
         (9, 0, "transit", ""), (None, 0, "transit", "22")], "od_id int, itin_id int, leg_type string, line_code string")
    alerts = spark.createDataFrame([("b", ["red", "22"]), ("a", ["22"]), ("a", ["22"]), ("c", ["X9"]), (None, ["red"])],
                                   "alert_id string, affected_routes array<string>")
    want = {(o, 0, x) for o in range(6) for x in ("a", "b", None)} | {(None, 0, x) for x in "ab"}
    got = [(r.od_id, r.itin_id, r.alert_id) for r in V.alerts_for(legs, alerts).collect()]
    assert len(got) == len(want) and set(got) == want
    lists = {(r.od_id, r.itin_id): (r.alerts, r.alert_ids) for r in V.alerts_for(legs, alerts, lists=True).collect()}
    assert lists == {**{(o, 0): (3, ["a", "b"]) for o in range(6)}, (None, 0): (2, ["a", "b"])}


@pytest.mark.parametrize("spread", [(1.0, 1.0), (1.0, 0.0), (0.0, 0.0)])
def test_nearest_point_of_a_shape(spark, spread):
    r = random.Random(3)
    pts = [(s, i, round(r.random() * spread[0], 2), round(r.random() * spread[1], 2)) for s in (1, 2) for i in range(200)] + [(3, 0, 5.0, 5.0)]
    spots = [(s, r.uniform(-3, 3), r.uniform(-1, 2)) for s in (1, 2, 3, 4) for _ in range(20)] + [(1, pts[0][2], pts[0][3])]
    found = I.nearest_on_shape(spark.createDataFrame(spots, "shape_id int, y double, x double"),
                               spark.createDataFrame(pts, "shape_id int, pos int, lat double, lon double"))
    got = {(f.shape_id, f.y, f.x): f.pos for f in found.collect()}
    assert got == {(s, y, x): min(((la - y) ** 2 + (lo - x) ** 2, i) for t, i, la, lo in pts if t == s)[1] for s, y, x in spots if s != 4}


def test_paths_need_no_round_for_every_block_of_the_graph(spark, monkeypatch):
    """On a street of 3,000 blocks landmark distances take hundreds of rounds; positions take one pass."""
    monkeypatch.setattr(W, "landmark_distances", lambda *_: pytest.fail("distances over the whole graph"))
    edges = spark.range(3000).selectExpr("id AS edge_id", "id AS u", "id + 1 AS v", "100D + id % 7 AS length")
    nodes = spark.range(3001).selectExpr("id AS node", "41.8D + id * 0.0009D AS lat", "-87.7D AS lon")
    pairs = spark.createDataFrame([(10, 14), (2000, 1997), (5, 900)], "source long, target long")
    got = {}
    for x in W.street_paths(pairs, edges, nodes, 0.5).collect():
        got.setdefault((x.source, x.target), []).append((x.edge_no, x.edge_id))
    assert {k: sorted(v) for k, v in got.items()} == {(10, 14): [(i, 10 + i) for i in range(4)], (2000, 1997): [(i, 1999 - i) for i in range(3)]}


def test_position_bounds_hold_with_short_cuts_and_unknown_places(spark):
    edges = [(1, 0, 1, 100.0), (2, 1, 2, 100.0), (3, 2, 3, 100.0), (4, 0, 3, 3.0)]
    for places, last in (([(i, 41.8 + i * 0.001, -87.7) for i in range(4)], 3.0), ([(0, 41.8, -87.7), (1, None, None), (2, float("nan"), -87.7)], 3.0)):
        e = spark.createDataFrame(edges, "edge_id int, u int, v int, length double")
        n = spark.createDataFrame(places, "node int, lat double, lon double")
        labels = W.search(spark.createDataFrame([(0, 3), (1, 3)], "source int, target int"), e, W.position_bounds(e, n), 1.0)
        assert {(x.source, x.metres) for x in labels.where("node = target").collect()} == {(0, last), (1, 103.0)}


def test_arcs_of_a_street_graph_are_not_broadcast(spark, monkeypatch):
    plans = []
    cut = R.cut_lineage
    monkeypatch.setattr(R, "cut_lineage", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or cut(df))
    edges = spark.createDataFrame([(0, 1, 10.0), (1, 2, 10.0)], "u int, v int, length double")
    got = {(x.source, x.node, x.metres) for x in R.street_distances(spark.createDataFrame([(0, 0)], "source int, node int"), edges, 1.0).collect()}
    assert got == {(0, 0, 0.0), (0, 1, 10.0), (0, 2, 20.0)}
    rounds = [p for p in plans if "Join" in p]
    assert rounds and all("strategy=merge" in p for p in rounds)
