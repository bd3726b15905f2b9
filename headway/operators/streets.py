"""Street graph: cleaning, components, distances, walking steps.

Iterative jobs keep one narrow table per round and cut its lineage with a
reliable checkpoint in the shared folder; convergence is read from one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..session import cut_lineage, save_table
from .spatial import cell_pairs, in_coverage, nearest_within

# Excluded ways, path types, pace, limits, block lengths, bands.
EXCLUDED_HIGHWAYS = ["service", "alley"]
PATH_TYPES = {
    "crossing": "crosswalk", "footway": "footway", "path": "path", "steps": "steps",
    "pedestrian": "pedestrian", "cycleway": "path", "track": "path",
}
METRES_PER_SECOND = 3.0 * 1609.34 / 3600
MAX_WALK_MILES = 5.0
SNAP_METRES = 1000.0
LONG_BLOCK, SHORT_BLOCK, LONG_EDGE = 201.17, 100.58, 150.0
MAX_STEPS = 15
MERGE_METRES = 10.0
BANDS = [(0.0, 0.25, "<=0.25 mi"), (0.25, 1.0, "0.25-1 mi"), (1.0, 3.0, "1-3 mi")]


def clean_street_edges(edges: DataFrame) -> DataFrame:
    """No service ways or alleys; opposite directions collapse to the shorter, lowest id first."""
    hw = F.trim(F.coalesce("highway", F.lit("")))
    attrs = F.struct("edge_id", "name", "highway", "footway")
    return (
        edges.where(~hw.isin(EXCLUDED_HIGHWAYS))
        .groupBy(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
        .agg(F.min(F.coalesce("length", F.lit(0.0))).alias("length"), F.min(attrs).alias("a"))
        .select("u", "v", "length", "a.edge_id", "a.name", "a.highway", "a.footway")
    )


def _signature(df: DataFrame) -> tuple:
    r = df.agg(F.count("*"), F.expr("sum(cast(pmod(xxhash64(u, v), 1000000007) as bigint))")).first()
    return tuple(r)


def components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(node, component): the least node id reachable, by alternating star contractions.

    Every round links each node to the least of its neighbours, first towards
    larger then towards smaller neighbours; rounds grow with the logarithm of
    the size. A hub is one row per neighbour, never a collected list.
    """
    e = edges.select("u", "v").where(F.col("u") != F.col("v")).distinct()
    e = cut_lineage(e)
    before = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where(F.col("v") > F.col("u")).select(
            F.col("v").alias("u"), F.col("m").alias("v"))
        down = large.where(F.col("u") != F.col("v")).distinct()
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = small.unionByName(least.select("u", F.col("m").alias("v"))).where(
            F.col("u") != F.col("v")).distinct()
        e = cut_lineage(e)
        now = _signature(e)
        if now == before:
            break
        before = now
    labelled = e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
    every = (nodes if nodes is not None else edges.select(F.col("u").alias("node")).unionByName(
        edges.select(F.col("v").alias("node")))).select("node").distinct()
    return every.join(labelled, "node", "left").withColumn(
        "component", F.coalesce("component", "node"))


def largest_component(labels: DataFrame) -> DataFrame:
    """Nodes of the component with most nodes, ties to the least label."""
    top = labels.groupBy("component").agg(F.count("*").alias("n")).orderBy(
        F.desc("n"), "component").limit(1)
    return labels.join(top.select("component"), "component", "left_semi").select("node")


def consolidate_nodes(nodes: DataFrame, edges: DataFrame,
                      metres: float = MERGE_METRES) -> tuple[DataFrame, DataFrame]:
    """Nodes within `metres` of each other, transitively, become one at their mean point.

    Nodes sharing a cell narrower than the limit are linked to its least node;
    pairs are formed only across such cells and between distinct points.
    """
    size = metres / 2 / 111_320.0  # cell diagonal below the limit at any latitude
    celled = nodes.withColumn("cy", geo.cell(F.col("lat"), size)).withColumn(
        "cx", geo.cell(F.col("lon"), size))
    head = celled.groupBy("cy", "cx").agg(F.min("node").alias("head"))
    star = celled.join(head, ["cy", "cx"]).where(F.col("node") != F.col("head")).select(
        F.col("node").alias("u"), F.col("head").alias("v"))
    spots = celled.groupBy("lat", "lon", "cy", "cx").agg(F.min("node").alias("node"))
    other = spots.select("lat", "lon", F.col("cy").alias("cy2"), F.col("cx").alias("cx2"),
                         F.col("node").alias("node2"))
    apart = (F.col("cy") != F.col("cy2")) | (F.col("cx") != F.col("cx2"))
    across = cell_pairs(spots, other, metres / geo.METRES_PER_MILE).where(
        apart & (F.col("node") < F.col("node2"))).select(
        F.col("node").alias("u"), F.col("node2").alias("v"))
    label = components(star.unionByName(across), nodes)
    merged = nodes.join(label, "node").groupBy(F.col("component").alias("node")).agg(
        F.avg("lat").alias("lat"), F.avg("lon").alias("lon"), F.count("*").alias("merged"))
    lu = label.select(F.col("node").alias("u"), F.col("component").alias("cu"))
    lv = label.select(F.col("node").alias("v"), F.col("component").alias("cv"))
    rebuilt = edges.join(lu, "u").join(lv, "v").where(F.col("cu") != F.col("cv")).drop(
        "u", "v").withColumnsRenamed({"cu": "u", "cv": "v"})
    return merged, rebuilt


def street_distances(sources: DataFrame, edges: DataFrame,
                     max_miles: float = MAX_WALK_MILES) -> DataFrame:
    """(source, node, metres): shortest street length from each source node within a limit.

    Each round extends only the labels improved in the round before.
    """
    limit = max_miles * geo.METRES_PER_MILE
    arcs = edges.select("u", "v", "length").unionByName(
        edges.select(F.col("v").alias("u"), F.col("u").alias("v"), "length")).where("u <> v")
    arcs = cut_lineage(arcs.groupBy("u", "v").agg(F.min("length").alias("length")))
    best = cut_lineage(sources.select(
        "source", "node", F.lit(0.0).alias("metres"), F.lit(0).alias("round")).distinct())
    i = 0
    while True:
        i += 1
        front = best.where(F.col("round") == i - 1)
        # arcs keep the size estimate of the few columns they were made from; they are never broadcast
        reach = front.join(arcs.hint("merge"), front["node"] == arcs["u"]).select(
            "source", F.col("v").alias("node"), (F.col("metres") + F.col("length")).alias("metres"),
            F.lit(i).alias("round")).where(F.col("metres") <= limit)
        best = cut_lineage(
            best.unionByName(reach).groupBy("source", "node")
            .agg(F.min(F.struct("metres", "round")).alias("m")).select("source", "node", "m.*"))
        if best.where(F.col("round") == i).isEmpty():
            return best.drop("round")


def snap_points(points: DataFrame, nodes: DataFrame) -> DataFrame:
    """Points with their nearest node at most 1 km away."""
    return nearest_within(points, nodes, SNAP_METRES / geo.METRES_PER_MILE, "node")


def street_walks(od: DataFrame, nodes: DataFrame, edges: DataFrame,
                 max_miles: float = MAX_WALK_MILES, detour: float = 1.0) -> DataFrame:
    """Walking minutes per (od_id): along streets, else in a straight line at 3 mph.

    Straight lines serve pairs beyond the limit, off the network or unconnected;
    `detour` may stretch them (1.0 as published). Each distinct pair of snapped nodes is
    searched towards its goal; the streets around a node are never laid out in full.
    """
    from .walks import position_bounds, search      # walks build on this module

    a = snap_points(od.select("od_id", F.col("o_lat").alias("lat"), F.col("o_lon").alias("lon")), nodes)
    b = snap_points(od.select("od_id", F.col("d_lat").alias("lat"), F.col("d_lon").alias("lon")), nodes)
    straight = geo.haversine(F.col("o_lat"), F.col("o_lon"), F.col("d_lat"), F.col("d_lon"))
    j = (
        od.withColumn("straight_miles", straight)
        .join(a.select("od_id", F.col("node").alias("source")).hint("merge"), "od_id", "left")
        .join(b.select("od_id", "node").hint("merge"), "od_id", "left")
    )
    j = save_table(j, "walk-ends")
    asked = j.where(F.col("straight_miles") <= max_miles).select("source", F.col("node").alias("target"))
    ways = edges.select("u", "v", "length", F.lit(0).alias("edge_id"))
    d = search(asked, ways, save_table(position_bounds(ways, nodes), "walk-bounds"), max_miles).where(
        "node = target").select("source", "node", "metres")
    metres = F.when(F.col("straight_miles") <= max_miles, F.col("metres"))
    walked = F.greatest(F.lit(0.1), F.round(metres / METRES_PER_SECOND / 60, 1))
    return j.join(d.hint("merge"), ["source", "node"], "left").select(
        "od_id", "straight_miles", (metres / 1609.34).alias("street_miles"),
        F.when(metres.isNotNull(), walked).otherwise(
            F.round(geo.walk_minutes(F.col("straight_miles") * detour), 1)).alias("minutes"),
        metres.isNotNull().alias("on_streets"))


def detour_factor(pairs: DataFrame) -> DataFrame:
    """Street / straight ratio: n, mean, 95 % interval, median, overall and by band.

    Medians are taken over ratios at four decimals with their counts, a table
    bounded by the accepted range, so no band is gathered whole.
    """
    ratio = F.col("street_miles") / F.col("straight_miles")
    ok = F.col("straight_miles").between(0.05, 3.0) & ratio.between(1.0, 3.0)
    band = F.lit(None).cast("string")
    for lo, hi, name in reversed(BANDS):
        band = F.when((F.col("straight_miles") >= lo) & (F.col("straight_miles") < hi), name).otherwise(band)
    tagged = pairs.where(ok).select(ratio.alias("ratio"), F.explode(F.array_compact(
        F.array(F.lit("all"), band))).alias("band"))
    half = 1.96 * F.coalesce(F.stddev_samp("ratio"), F.lit(0.0)) / F.sqrt(F.count("*"))
    stats = tagged.groupBy("band").agg(
        F.count("*").alias("n"), F.avg("ratio").alias("mean"), half.alias("half"))
    mid = (
        tagged.groupBy("band", F.round("ratio", 4).alias("r")).agg(F.count("*").alias("c"))
        .groupBy("band").agg(F.percentile("r", F.lit(0.5), F.col("c")).alias("median"))
    )
    return stats.join(mid, "band").select(
        "band", "n", F.round("mean", 4).alias("mean"),
        F.round(F.col("mean") - F.col("half"), 4).alias("ci_low"),
        F.round(F.col("mean") + F.col("half"), 4).alias("ci_high"), F.round("median", 4).alias("median"))


def sample_pairs(points: DataFrame, fraction: float, seed: int = 0) -> DataFrame:
    """Seeded sample of covered origin-destination pairs, the calibration's input."""
    covered = in_coverage(F.col("o_lat"), F.col("o_lon")) & in_coverage(F.col("d_lat"), F.col("d_lon"))
    return points.where(covered).sample(fraction=fraction, seed=seed)


def path_type(highway: Column, footway: Column) -> Column:
    pairs = [F.lit(x) for kv in PATH_TYPES.items() for x in kv]
    hw = F.trim(F.coalesce(highway, F.lit("")))
    return F.when(F.trim(footway) == "crossing", "crosswalk").otherwise(
        F.coalesce(F.try_element_at(F.create_map(*pairs), hw), F.lit("")))


def walk_steps(path_edges: DataFrame, max_steps: int = MAX_STEPS) -> DataFrame:
    """Consecutive edges of one street, or of one unnamed path type, become a step.

    A path is a simple walk of at most five miles, so its edges fit one window.
    """
    w = Window.partitionBy("path_id").orderBy("edge_no")
    name = F.trim(F.coalesce("name", F.lit("")))
    kind = path_type(F.col("highway"), F.col("footway"))
    key = F.when(name != "", F.concat(F.lit("s:"), name)).otherwise(F.concat(F.lit("t:"), kind))
    e = path_edges.withColumn("street", name).withColumn("path_type", kind).withColumn("_key", key)
    fresh = F.coalesce((F.lag("_key").over(w) != F.col("_key")).cast("int"), F.lit(1))
    e = e.withColumn("_new", fresh).withColumn("step_no", F.sum("_new").over(w)).where(
        F.col("step_no") <= max_steps)
    s = e.groupBy("path_id", "step_no").agg(
        F.min_by(F.struct("street", "path_type", "lat1", "lon1"), "edge_no").alias("a"),
        F.max_by(F.struct("lat2", "lon2"), "edge_no").alias("b"),
        F.sum("length").alias("metres"), F.count("*").alias("edges"))
    long = F.col("metres") / F.col("edges") >= LONG_EDGE
    block = F.when(long, LONG_BLOCK).otherwise(SHORT_BLOCK)
    return s.select(
        "path_id", "step_no", "a.street", "a.path_type",
        geo.heading8(F.col("a.lat1"), F.col("a.lon1"), F.col("b.lat2"), F.col("b.lon2")).alias("direction"),
        F.greatest(F.lit(0.5), F.round(F.col("metres") / block * 2) / 2).alias("blocks"),
        F.when(long, "long").otherwise("short").alias("block_type"),
        F.round(F.col("metres") / METRES_PER_SECOND / 60, 1).alias("minutes"),
        F.col("a.lat1").alias("start_lat"), F.col("a.lon1").alias("start_lon"))
