"""Street walks search each pair towards its goal; nothing is laid out around a node."""

import random

import pytest
from test_walks import dijkstra, graph

from headway.operators import streets as R


def test_street_walks_equal_dijkstra_without_laying_out_all_nodes(spark, monkeypatch):
    nodes, edges = graph(6, 3)
    edges = [e for e in edges if e[3] > 0]
    r = random.Random(2)
    asked = [(i, *r.sample(range(36), 2)) for i in range(40)] + [(40, 5, 5)]
    at = {n: (lat, lon) for n, lat, lon in nodes}
    frame = spark.createDataFrame

    def never(*_):
        raise AssertionError("all streets around the sources were laid out")

    monkeypatch.setattr(R, "street_distances", never)
    od = frame([(i, *at[a], *at[b]) for i, a, b in asked] + [(99, 45.0, -80.0, *at[0])], "od_id int, o_lat double, o_lon double, d_lat double, d_lon double")
    got = {x.od_id: x for x in R.street_walks(od, frame(nodes, "node int, lat double, lon double"),
                                              frame([e[1:4] for e in edges], "u int, v int, length double"), 0.5).collect()}
    on = 0
    for i, a, b in asked:
        metres = dijkstra(edges, a).get(b)
        if got[i].straight_miles <= 0.5 and metres is not None and metres <= 0.5 * 1609.344:
            on += 1
            assert got[i].on_streets and got[i].street_miles == pytest.approx(metres / 1609.34)
        else:
            assert not got[i].on_streets and got[i].street_miles is None
    assert 3 < on < 41 and not got[99].on_streets
