import heapq
import random

from headway.operators import streets as R
from headway.operators import walks as W

EDGE = "edge_id int, u int, v int, length double, name string, highway string, footway string"


def graph(n, seed, holes=0.15):
    """A grid of n x n nodes with some edges missing, some of length 0, some doubled."""
    r = random.Random(seed)
    nodes = [(i * n + j, 41.8 + i * 0.001, -87.7 + j * 0.0013) for i in range(n) for j in range(n)]
    pairs = [(i * n + j, k) for i in range(n) for j in range(n)
             for k in ([i * n + j + 1] if j + 1 < n else []) + ([(i + 1) * n + j] if i + 1 < n else [])]
    pairs = [p for p in pairs if r.random() > holes]
    pairs += r.sample(pairs, 5) + [(7, 7)]
    return nodes, [(k, u, v, r.choice([0.0, 80.0, 100.0, 100.0, 130.0]), r.choice(["A", "B", ""]), "residential", "")
                   for k, (u, v) in enumerate(pairs)]


def dijkstra(edges, source):
    near = {}
    for _, u, v, w, *_ in edges:
        near.setdefault(u, []).append((v, w))
        near.setdefault(v, []).append((u, w))
    heap, seen = [(0.0, source)], {}
    while heap:
        d, x = heapq.heappop(heap)
        if x not in seen:
            seen[x] = d
            for y, w in near.get(x, []):
                heapq.heappush(heap, (d + w, y))
    return seen


def test_paths_equal_dijkstra(spark):
    nodes, edges = graph(7, 4)
    r = random.Random(1)
    asked = [(r.randrange(49), r.randrange(49)) for _ in range(25)] + [(3, 3), (0, 48), (0, 48), (None, 4), (5, None), (5, 999)]
    e = spark.createDataFrame(edges, EDGE)
    n = spark.createDataFrame(nodes, "node int, lat double, lon double")
    pairs = spark.createDataFrame(asked, "source int, target int")
    limit = 900.0 / 1609.344
    bounds = W.landmark_distances(e, n)
    labels = W.search(pairs, e, bounds, limit)
    got = {(x.source, x.target): x.metres for x in labels.where("node = target").collect()}
    want = {(s, t): d[t] for s, t in asked if s is not None and t in (d := dijkstra(edges, s)) and d[t] <= 900.0}
    assert got == want
    path = {}
    for x in W.paths(labels).collect():
        path.setdefault((x.source, x.target), []).append(x)
    length = {k: w for k, _, _, w, *_ in edges}
    ends = {k: {u, v} for k, u, v, *_ in edges}
    for pair, metres in want.items():
        steps = sorted(path.pop(pair, []), key=lambda x: x.edge_no)
        at, far = pair[0], 0.0
        for i, x in enumerate(steps):
            assert (x.edge_no, x.u) == (i, at) and ends[x.edge_id] == {x.u, x.v}
            at, far = x.v, far + length[x.edge_id]
            assert x.metres == far
        assert (at, far) == (pair[1], metres)
    assert not path
    # Directed: labels stay near the way to the goal.
    everywhere = R.street_distances(pairs.select("source", F_source(pairs)).distinct().where("source is not null"), e, limit).count()
    assert labels.groupBy("source", "target").count().agg({"count": "max"}).first()[0] <= everywhere


def F_source(df):
    return df["source"].alias("node")


def test_bounds_never_exceed_a_path(spark):
    nodes, edges = graph(6, 9, holes=0.3)
    e, n = spark.createDataFrame(edges, EDGE), spark.createDataFrame(nodes, "node int, lat double, lon double")
    away = {x.node: x.away for x in W.landmark_distances(e, n).collect()}
    for s in range(36):
        for t, d in dijkstra(edges, s).items():
            if s in away and t in away:
                assert all(abs(a - b) <= d + 1e-6 for a, b in zip(away[s], away[t], strict=True) if a is not None and b is not None)


def test_steps_of_a_found_path(spark):
    nodes = [(i, 41.9 + i * 0.001, -87.6) for i in range(5)]
    edges = [(i, i, i + 1, 110.0, "Oak" if i < 2 else "Elm", "residential", "") for i in range(4)]
    e, n = spark.createDataFrame(edges, EDGE), spark.createDataFrame(nodes, "node int, lat double, lon double")
    found = W.street_paths(spark.createDataFrame([(4, 0), (0, 0)], "source int, target int"), e, n)
    steps = R.walk_steps(W.directed_edges(found, e, n)).sort("step_no").collect()
    assert [(s.path_id, s.street, s.direction, s.blocks) for s in steps] == [("4-0", "Elm", "S", 2.0), ("4-0", "Oak", "S", 2.0)]


def test_empty_tables(spark):
    e, n = spark.createDataFrame([], EDGE), spark.createDataFrame([], "node int, lat double, lon double")
    assert W.street_paths(spark.createDataFrame([(1, 2)], "source int, target int"), e, n).count() == 0
    nodes, edges = graph(3, 1)
    e, n = spark.createDataFrame(edges, EDGE), spark.createDataFrame(nodes, "node int, lat double, lon double")
    assert W.street_paths(spark.createDataFrame([], "source int, target int"), e, n).count() == 0
