"""Shortest street paths of many pairs: a search directed at each pair's goal, and its paths.

A label is (pair, node) with the street length so far, the hops, and the node
and edge it came by. Lower bounds to the goal come from positions along a few
directions, each scaled so that no edge is shorter than its ends are apart; or
from landmarks: by the triangle inequality no path is shorter than the difference
of the distances of its ends from a landmark, but finding those distances takes
as many rounds as the graph is wide. A label that cannot reach its goal within the limit of
its pair, or within the best length found so far, is not extended, so a round
holds labels of open pairs only. Rounds are written once and never rewritten,
but for a merge every few rounds.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..session import cut_lineage, release_shuffles, save_table
from .streets import MAX_WALK_MILES, street_distances

#: Round tables after which they are merged.
MERGE_ROUNDS = 8
#: Times that arcs are joined with themselves before landmark distances are found: eight hops a round.
DOUBLINGS = 3
#: Directions, over half a turn, along which positions bound a path from below.
DIRECTIONS = 8
#: Metres by which sums of doubles may differ.
SLACK = 1e-6
_KEY = ["source", "target", "node"]
_FROM = ["metres", "hops", "prev", "edge_id"]


def arcs_of(edges: DataFrame) -> DataFrame:
    """Edges in both directions, of parallel ones the shortest, the least id first."""
    both = edges.select("u", "v", "length", "edge_id").unionByName(
        edges.select(F.col("v").alias("u"), F.col("u").alias("v"), "length", "edge_id")).where("u <> v")
    return both.groupBy("u", "v").agg(F.min(F.struct("length", "edge_id")).alias("e")).select("u", "v", "e.*")


def landmarks(nodes: DataFrame) -> DataFrame:
    """The outermost nodes in the eight directions (node); the least id where several lie equally far out."""
    x, y = F.col("lon") * F.cos(F.radians("lat")), F.col("lat")
    far = [F.min(F.struct(sign * (a * x + b * y), F.col("node"))) for a, b in ((1, 0), (0, 1), (1, 1), (1, -1)) for sign in (1, -1)]
    ends = nodes.agg(*(f.alias(f"m{i}") for i, f in enumerate(far)))
    return ends.select(F.explode(F.array(*(F.col(f"m{i}.node") for i in range(len(far))))).alias("node")).where("node is not null").distinct()


def shortcuts(edges: DataFrame, doublings: int = DOUBLINGS) -> DataFrame:
    """(u, v, length) of all node pairs up to 2 ** doublings hops apart, so that a search takes fewer rounds."""
    a = save_table(arcs_of(edges).select("u", "v", "length"), "walk-shortcuts")
    for _ in range(doublings):
        onward = a.select(F.col("u").alias("v"), F.col("v").alias("w"), F.col("length").alias("more"))
        two = a.join(onward, "v").where("u <> w").select("u", F.col("w").alias("v"), (F.col("length") + F.col("more")).alias("length"))
        a = save_table(a.unionByName(two).groupBy("u", "v").agg(F.min("length").alias("length")), "walk-shortcuts")
    return a.where("u < v")


def landmark_distances(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, away): street metres from every landmark, null where there is no way. Made once for a street graph."""
    marks = landmarks(nodes)
    d = street_distances(marks.select(F.col("node").alias("source"), "node"), shortcuts(edges), float("inf"))
    every = d.groupBy("node").agg(F.map_from_entries(F.collect_list(F.struct("source", "metres"))).alias("m"))   # a few per node
    order = sorted(r.node for r in marks.collect())                                                              # eight at most
    away = [F.try_element_at("m", F.lit(k)) for k in order]
    return cut_lineage(every.select("node", F.array(*away).cast("array<double>").alias("away")))


def position_bounds(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, away): where a node lies along each direction, in metres of the most direct streets.

    In each direction the scale is the least length of an edge for each degree it
    leads that way, so along any path the difference of two nodes is at most its
    length. One pass over the edges, however large the graph; an edge of no
    length, or to a node without a place, leaves its directions without a bound.
    """
    mid = F.broadcast(nodes.agg(F.cos(F.radians(F.coalesce(F.avg(F.nanvl("lat", F.lit(None))), F.lit(0.0)))).alias("squeeze")))
    turn = [math.pi * i / DIRECTIONS for i in range(DIRECTIONS)]
    along = F.array(*(F.col("lat") * math.sin(t) + F.col("lon") * F.col("squeeze") * math.cos(t) for t in turn))
    at = save_table(nodes.groupBy("node").agg(F.min(F.struct("lat", "lon")).alias("p")).select("node", "p.*")
                    .crossJoin(mid).select("node", along.cast("array<double>").alias("at")), "walk-positions")
    u, v = at.select(F.col("node").alias("u"), F.col("at").alias("at_u")), at.select(F.col("node").alias("v"), F.col("at").alias("at_v"))
    ends = edges.where("u <> v").join(u, "u", "left").join(v, "v", "left")

    def scale(i: int) -> Column:
        apart = F.abs(F.get("at_u", F.lit(i)) - F.get("at_v", F.lit(i)))
        # what leads nowhere in this direction bounds nothing; an unknown place bounds everything
        return F.min(F.when(apart.isNull() | F.isnan(apart), 0.0).when(apart > 0, F.col("length") / apart)).alias(f"s{i}")

    scales = F.broadcast(ends.agg(*(scale(i) for i in range(DIRECTIONS))).select(
        F.array(*(F.coalesce(f"s{i}", F.lit(0.0)) for i in range(DIRECTIONS))).alias("scale")))
    # rounding of sums along a path stays far below this share
    away = F.zip_with("at", "scale", lambda x, s: F.when(~F.isnan(x), x * s * (1 - 1e-6)))
    return at.crossJoin(scales).select("node", away.alias("away"))


def least_metres(a: Column, b: Column) -> Column:
    """No street path between nodes with these landmark distances is shorter."""
    apart = F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x - y)))
    return F.coalesce(apart, F.lit(0.0))


def _best(labels: DataFrame) -> DataFrame:
    return labels.groupBy(*_KEY).agg(F.min(F.struct(*_FROM)).alias("m")).select(*_KEY, "m.*")


def search(pairs: DataFrame, edges: DataFrame, bounds: DataFrame, max_miles: float = MAX_WALK_MILES) -> DataFrame:
    """Labels (source, target, node, metres, hops, prev, edge_id) of all distinct pairs (source, target).

    The label of a pair at its target is its street length; a pair that is
    unconnected or farther apart than the limit has none there. Of paths of one
    length the one with fewest edges counts, then the least previous node and edge.
    """
    limit = max_miles * geo.METRES_PER_MILE
    asked = pairs.select("source", "target").where("source IS NOT NULL AND target IS NOT NULL").distinct()
    goal = bounds.select(F.col("node").alias("target"), F.col("away").alias("goal"))
    begin = bounds.select(F.col("node").alias("source"), F.col("away").alias("begin"))
    asked = asked.join(goal, "target", "left").join(begin, "source", "left")
    asked = save_table(asked.where(least_metres(F.col("begin"), F.col("goal")) <= limit + SLACK).drop("begin"), "walk-pairs")
    arcs = arcs_of(edges).join(bounds.select(F.col("node").alias("v"), "away"), "v", "left")
    arcs = save_table(arcs, "walk-arcs")
    schema = {f.name: f.dataType for f in arcs.schema}
    first = asked.select("source", "target", F.col("source").alias("node"), F.lit(0.0).alias("metres"), F.lit(0).alias("hops"),
                         F.lit(None).cast(schema["u"]).alias("prev"), F.lit(None).cast(schema["edge_id"]).alias("edge_id"))
    front = save_table(first, "walk-round")
    parts = [front]
    while True:
        seen = reduce(DataFrame.unionByName, parts)
        reached = seen.where("node = target").groupBy("source", "target").agg(F.min("metres").alias("found"))
        open_ = front.join(asked, ["source", "target"]).join(reached, ["source", "target"], "left").where("node <> target")
        step = open_.join(arcs, open_["node"] == arcs["u"]).select(
            "source", "target", F.col("v").alias("node"), (F.col("metres") + F.col("length")).alias("metres"),
            (F.col("hops") + 1).alias("hops"), F.col("node").alias("prev"), arcs["edge_id"], "found",
            least_metres(F.col("away"), F.col("goal")).alias("rest"))
        step = step.where(F.col("metres") + F.col("rest") <= F.least(F.lit(limit), F.col("found")) + SLACK)
        step = _best(step.where(F.col("metres") <= limit))
        old = seen.join(front.select("source", "target").distinct(), ["source", "target"], "left_semi")
        old = _best(old).select(*_KEY, F.struct(*_FROM).alias("old"))
        new = step.join(old, _KEY, "left").where(F.col("old").isNull() | (F.struct(*_FROM) < F.col("old"))).drop("old")
        front = save_table(new, "walk-round")
        release_shuffles(edges.sparkSession)
        if front.isEmpty():
            return _best(seen)
        parts.append(front)
        if len(parts) > MERGE_ROUNDS:
            parts = [save_table(_best(reduce(DataFrame.unionByName, parts)), "walk-labels")]


def paths(labels: DataFrame) -> DataFrame:
    """(source, target, edge_no, u, v, edge_id, metres) of every found path, edges in order from 0, metres up to the end of each.

    The way back from a target is unrolled by pointer doubling: with links to the
    ancestors 1, 2, 4, … hops back, a path of n edges takes log n joins.
    """
    found = labels.where("node = target")
    tree = labels.join(found.select("source", "target", F.col("metres").alias("all")), ["source", "target"], "left_semi")
    tree = save_table(tree, "walk-tree")
    longest = tree.where("node = target").agg(F.max("hops")).first()[0] or 0
    jumps = [tree.where("hops > 0").select(*_KEY, F.col("prev").alias("back"))]
    for _ in range(1, longest.bit_length()):
        j = jumps[-1]
        further = j.select("source", "target", F.col("node").alias("back"), F.col("back").alias("farther"))
        jumps.append(save_table(j.join(further, ["source", "target", "back"]).select(*_KEY, F.col("farther").alias("back")), "walk-jumps"))
    marks = tree.where("node = target").select(*_KEY)
    for j in reversed(jumps):
        marks = marks.unionByName(marks.join(j, _KEY).select("source", "target", F.col("back").alias("node")))
    return marks.join(tree, _KEY).where("hops > 0").select(
        "source", "target", (F.col("hops") - 1).alias("edge_no"), F.col("prev").alias("u"), F.col("node").alias("v"), "edge_id", "metres")


def street_paths(pairs: DataFrame, edges: DataFrame, nodes: DataFrame, max_miles: float = MAX_WALK_MILES,
                 bounds: DataFrame | None = None) -> DataFrame:
    """Edges of the shortest street path of every distinct pair (source, target) of nodes within the limit."""
    bounds = save_table(position_bounds(edges, nodes), "walk-bounds") if bounds is None else bounds
    return paths(search(pairs, edges, bounds, max_miles))


def directed_edges(street_path: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Path edges as `walk_steps` takes them: with names, kinds, lengths and the points of both ends in walking order."""
    at = nodes.select("node", "lat", "lon")
    a = at.select(F.col("node").alias("u"), F.col("lat").alias("lat1"), F.col("lon").alias("lon1"))
    b = at.select(F.col("node").alias("v"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    kept = edges.groupBy("edge_id").agg(F.first(F.struct("name", "highway", "footway", "length")).alias("e"))
    return street_path.join(kept, "edge_id").join(a, "u").join(b, "v").select(
        F.concat_ws("-", "source", "target").alias("path_id"), "edge_no", "e.*", "lat1", "lon1", "lat2", "lon2")
