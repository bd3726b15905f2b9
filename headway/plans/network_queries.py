"""Registered queries: transit network and street graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import network as N
from ..operators import spatial as P
from ..operators import streets as R
from ..operators import walks as W
from ..sources import adapters as S
from .feed import Feed
from .registry import query
from .spatial_queries import miles
from .views import with_views

HOPS = f"""v_lead AS (SELECT period, trip_id, route_id, direction_id, mode, stop_id AS from_id, pos, dep_min,
      lead(stop_id) OVER w AS to_id, lead(dep_min) OVER w - dep_min AS m FROM v_rep_stops WINDOW w AS (PARTITION BY period, trip_id ORDER BY pos)),
   v_rail AS (SELECT period, from_id, to_id, route_id, min(m) AS minutes FROM v_lead
      WHERE mode = 'rail' AND from_id <> to_id AND m > 0 AND m <= 45
        AND from_id IN (SELECT stop_id FROM v_stops WHERE kind = 'station') AND to_id IN (SELECT stop_id FROM v_stops WHERE kind = 'station')
      GROUP BY ALL),
   v_ends AS (SELECT r.period, r.trip_id, arg_min(s.lat, r.pos) AS lat1, arg_min(s.lon, r.pos) AS lon1, arg_max(s.lat, r.pos) AS lat2, arg_max(s.lon, r.pos) AS lon2
      FROM v_rep_stops r JOIN v_stops s USING (stop_id) WHERE r.mode = 'bus' GROUP BY ALL),
   v_brg AS (SELECT period, trip_id, (degrees(atan2(sin(radians(lon2 - lon1)) * cos(radians(lat2)), cos(radians(lat1)) * sin(radians(lat2))
        - sin(radians(lat1)) * cos(radians(lat2)) * cos(radians(lon2 - lon1)))) + 360) % 360 AS b FROM v_ends),
   v_hops AS (SELECT period, from_id, to_id, CAST(min(minutes) AS DOUBLE) AS minutes, 'transit' AS edge_type, 'rail' AS mode,
        arg_min(route_id, struct_pack(m := minutes, r := route_id)) AS route_id, arg_min(route_id, struct_pack(m := minutes, r := route_id)) AS line,
        CASE WHEN count(*) > 1 THEN string_agg(route_id, ',' ORDER BY route_id) END AS routes FROM v_rail GROUP BY ALL
      UNION ALL SELECT l.period, l.from_id, l.to_id, CAST(greatest(l.m, 0.5) AS DOUBLE), 'transit', 'bus', l.route_id,
        CASE WHEN b < 45 OR b >= 315 THEN 'Northbound' WHEN b < 135 THEN 'Eastbound' WHEN b < 225 THEN 'Southbound' ELSE 'Westbound' END, NULL
      FROM v_lead l JOIN v_brg USING (period, trip_id) WHERE l.mode = 'bus' AND l.to_id IS NOT NULL),
   v_transfer_raw AS (SELECT CASE p_partkey % 4 WHEN 0 THEN p_partkey // 4 % 10000 + 40000 WHEN 1 THEN p_partkey // 4 % 10000 + 40000 ELSE p_partkey % 30000 END AS a,
        (p_partkey // 4) * 4 + p_partkey % 12 AS k2, CASE WHEN p_partkey % 6 = 0 THEN 0 ELSE p_partkey * 13 % 600 END AS sec FROM part),
   v_t1 AS (SELECT a, CASE WHEN k2 % 4 IN (0, 1) THEN k2 // 4 % 10000 + 40000 ELSE k2 % 30000 END AS b, greatest(sec / 60.0, 3.0) AS minutes FROM v_transfer_raw),
   v_t2 AS (SELECT * FROM v_t1 WHERE a <> b AND a IN (SELECT stop_id FROM v_stops WHERE kind = 'station') AND b IN (SELECT stop_id FROM v_stops WHERE kind = 'station')),
   v_transfers AS (SELECT from_id, to_id, min(minutes) AS minutes FROM (SELECT a AS from_id, b AS to_id, minutes FROM v_t2 UNION ALL SELECT b, a, minutes FROM v_t2) GROUP BY ALL),
   v_near AS (SELECT s.stop_id AS from_id, b.stop_id AS to_id, {miles('b', 's')} AS miles FROM v_stops s JOIN v_stops b
        ON s.kind = 'station' AND b.kind = 'bus' AND abs(s.lat - b.lat) < 0.01 AND abs(s.lon - b.lon) < 0.01),
   v_walk AS (SELECT * FROM (SELECT from_id, to_id, greatest(miles / 3.0 * 60.0 * 1.29, 3.0) AS minutes FROM v_near WHERE miles <= 0.15
      UNION ALL SELECT to_id, from_id, greatest(miles / 3.0 * 60.0 * 1.29, 3.0) FROM v_near WHERE miles <= 0.15) WHERE minutes <= 5)"""


def edge_text(df):
    return df.select(
        "period", "from_id", "to_id", F.round("minutes", 6).alias("minutes"), "edge_type", "mode", "route_id", "line",
        F.array_join(F.transform("all_routes", lambda x: x["route_id"]), ",").alias("routes"))


@query("hop_edges", with_views(["v_rep_stops", "v_stops"], """
    SELECT period, CAST(from_id AS VARCHAR) AS from_id, CAST(to_id AS VARCHAR) AS to_id, minutes, edge_type, mode, route_id, line, routes FROM v_hops""", HOPS))
def hop_edges(spark, sf_dir):
    f = Feed.from_tables(spark, sf_dir)
    return edge_text(N.hop_edges(f.rep_stops, f.stops))


@query("transfer_edges", with_views(["v_rep_stops", "v_stops"], """
    SELECT CAST(from_id AS VARCHAR) AS from_id, CAST(to_id AS VARCHAR) AS to_id, round(minutes, 6) AS minutes FROM v_transfers""", HOPS))
def transfer_edges(spark, sf_dir):
    f = Feed.from_tables(spark, sf_dir)
    return N.transfer_edges(f.tables["transfers"], f.stops).withColumn("minutes", F.round("minutes", 6))


@query("network_edges", with_views(["v_rep_stops", "v_stops"], """
    SELECT period, CAST(from_id AS VARCHAR) AS from_id, CAST(to_id AS VARCHAR) AS to_id, round(minutes, 6) AS minutes, edge_type, mode, route_id, line, routes FROM (
      SELECT * FROM v_hops
      UNION ALL SELECT p.period, from_id, to_id, minutes, 'transfer', 'rail', 'transfer', 'transfer', NULL FROM v_transfers t
        CROSS JOIN (SELECT DISTINCT period FROM v_rep_stops) p
        WHERE NOT EXISTS (SELECT 1 FROM v_hops h WHERE h.period = p.period AND h.from_id = t.from_id AND h.to_id = t.to_id)
      UNION ALL SELECT p.period, from_id, to_id, minutes, 'walk', 'walk', 'walk', 'walk', NULL FROM v_walk
        CROSS JOIN (SELECT DISTINCT period FROM v_rep_stops) p)""", HOPS))
def network_edges(spark, sf_dir):
    f = Feed.from_tables(spark, sf_dir)
    return edge_text(N.network_edges(f.rep_stops, f.stops, f.tables["transfers"]))


@query("rides", with_views(["v_rep_stops"], """
    SELECT a.period, a.route_id, a.direction_id, a.mode, CAST(a.stop_id AS VARCHAR) AS board_id, CAST(b.stop_id AS VARCHAR) AS alight_id,
           CAST(a.pos AS INTEGER) AS board_pos, CAST(b.pos AS INTEGER) AS alight_pos,
           CAST(CASE WHEN b.dep_min < a.dep_min THEN b.dep_min - a.dep_min + 1440 ELSE b.dep_min - a.dep_min END AS DOUBLE) AS minutes
    FROM v_rep_stops a JOIN v_rep_stops b USING (period, trip_id) WHERE a.pos < b.pos AND a.stop_id <> b.stop_id AND a.dep_min <> b.dep_min"""))
def rides(spark, sf_dir):
    return N.rides(Feed.from_tables(spark, sf_dir).rep_stops)


STREETS = """v_e0 AS (SELECT p_partkey AS k, side, CASE side WHEN 2 THEN p_partkey + 1 ELSE p_partkey END AS u,
      CASE side WHEN 0 THEN p_partkey + 1 WHEN 1 THEN p_partkey + 40 ELSE p_partkey END AS v FROM part CROSS JOIN (VALUES (0),(1),(2)) s(side)),
   v_e1 AS (SELECT k * 3 + side AS edge_id, u, v, 112.0 + k % 7 * 10 + side AS length, CASE WHEN side = 1 THEN 'Oak' || (k % 40) WHEN k % 9 = 0 THEN '' ELSE 'Elm' || (k // 40) END AS name,
      CASE WHEN k % 17 = 0 THEN 'service' WHEN k % 9 = 0 THEN 'footway' ELSE 'residential' END AS highway
      FROM v_e0 WHERE (side = 1 OR greatest(u, v) % 40 <> 0) AND greatest(u, v) IN (SELECT p_partkey FROM part)),
   v_edges AS (SELECT least(u, v) AS u, greatest(u, v) AS v, min(length) AS length, min(edge_id) AS edge_id, arg_min(name, edge_id) AS name,
      arg_min(highway, edge_id) AS highway FROM v_e1 WHERE highway <> 'service' GROUP BY 1, 2)"""


@query("clean_street_edges", f"WITH {STREETS} SELECT u, v, CAST(length AS DOUBLE) AS length, edge_id, name, highway FROM v_edges")
def clean_street_edges(spark, sf_dir):
    return R.clean_street_edges(S.street_edges_raw(spark, sf_dir)).drop("footway")


@query("components", f"""WITH RECURSIVE {STREETS},
    e AS (SELECT u, v FROM v_edges WHERE length >= 130 UNION SELECT v, u FROM v_edges WHERE length >= 130),
    n AS (SELECT u AS node FROM v_edges UNION SELECT v FROM v_edges),
    r(node, c) AS (SELECT node, node FROM n UNION SELECT e.v, r.c FROM r JOIN e ON e.u = r.node WHERE r.c < e.v)
    SELECT node, min(c) AS component FROM r GROUP BY node""")
def components(spark, sf_dir):
    e = R.clean_street_edges(S.street_edges_raw(spark, sf_dir))
    nodes = e.select(F.col("u").alias("node")).unionByName(e.select(F.col("v").alias("node")))
    return R.components(e.where(F.col("length") >= 130), nodes)


@query("largest_component", f"""WITH RECURSIVE {STREETS},
    e AS (SELECT u, v FROM v_edges WHERE length >= 130 UNION SELECT v, u FROM v_edges WHERE length >= 130),
    n AS (SELECT u AS node FROM v_edges UNION SELECT v FROM v_edges),
    r(node, c) AS (SELECT node, node FROM n UNION SELECT e.v, r.c FROM r JOIN e ON e.u = r.node WHERE r.c < e.v),
    l AS (SELECT node, min(c) AS component FROM r GROUP BY node)
    SELECT node FROM l WHERE component = (SELECT component FROM l GROUP BY component ORDER BY count(*) DESC, component LIMIT 1)""")
def largest_component(spark, sf_dir):
    return R.largest_component(components(spark, sf_dir))


@query("consolidate_nodes")
def consolidate_nodes(spark, sf_dir):
    e = R.clean_street_edges(S.street_edges_raw(spark, sf_dir))
    return R.consolidate_nodes(S.street_nodes(spark, sf_dir), e)[0]


@query("street_distances")
def street_distances(spark, sf_dir):
    """Everything within half a mile of every supplier's node."""
    e = R.clean_street_edges(S.street_edges_raw(spark, sf_dir))
    s = S.table(spark, sf_dir, "supplier").select((F.col("s_suppkey") * 17 % 997).alias("source"))
    return R.street_distances(s.withColumn("node", F.col("source")), e, 0.5)


def calibration(spark, sf_dir):
    """Neighbouring points of the grid: street length against straight line."""
    e = R.clean_street_edges(S.street_edges_raw(spark, sf_dir))
    k, n = F.col("p_partkey"), S.street_nodes(spark, sf_dir)
    p = S.table(spark, sf_dir, "part")
    od = p.select(k.alias("od_id"), (F.lit(41.8001) + F.floor(k / 40) * 0.001).alias("o_lat"),
                  (F.lit(-87.7501) + k % 40 * 0.0014).alias("o_lon"),
                  (F.lit(41.8021) + F.floor(k / 40) * 0.001).alias("d_lat"),
                  (F.lit(-87.7471) + k % 40 * 0.0014).alias("d_lon"))
    return R.street_walks(od, n, e, 0.5)


@query("street_walks")
def street_walks(spark, sf_dir):
    return calibration(spark, sf_dir)


@query("detour_factor", """WITH p AS (SELECT (l_extendedprice + 1000) / (5000 + l_partkey) AS straight_miles, (l_extendedprice + 1000) / (5000 + l_partkey) * (0.9 + l_quantity / 25.0) AS street_miles FROM lineitem),
    q AS (SELECT *, street_miles / straight_miles AS ratio FROM p WHERE straight_miles BETWEEN 0.05 AND 3 AND street_miles / straight_miles BETWEEN 1 AND 3),
    b AS (SELECT 'all' AS band, ratio FROM q UNION ALL SELECT CASE WHEN straight_miles < 0.25 THEN '<=0.25 mi' WHEN straight_miles < 1 THEN '0.25-1 mi' ELSE '1-3 mi' END, ratio FROM q WHERE straight_miles < 3)
    SELECT band, count(*) AS n, round(avg(ratio), 4) AS mean, round(avg(ratio) - 1.96 * coalesce(stddev_samp(ratio), 0) / sqrt(count(*)), 4) AS ci_low,
      round(avg(ratio) + 1.96 * coalesce(stddev_samp(ratio), 0) / sqrt(count(*)), 4) AS ci_high, round(median(round(ratio, 4)), 4) AS median FROM b GROUP BY band""")
def detour_factor(spark, sf_dir):
    li = S.table(spark, sf_dir, "lineitem")
    straight = (F.col("l_extendedprice") + 1000) / (5000 + F.col("l_partkey"))
    return R.detour_factor(li.select(straight.alias("straight_miles"),
                                     (straight * (0.9 + F.col("l_quantity") / 25.0)).alias("street_miles")))


@query("walk_steps", """WITH e AS (SELECT p_partkey // 25 AS path_id, p_partkey % 25 AS edge_no, CASE WHEN p_partkey % 7 = 0 THEN '' ELSE 'Elm' || (p_partkey // 3 % 5) END AS street,
      CASE WHEN p_partkey % 28 = 0 THEN 'crosswalk' WHEN p_partkey % 14 = 0 THEN 'footway' ELSE '' END AS path_type, 60.0 + p_partkey * 13 % 200 AS length, p_partkey AS k FROM part),
    f AS (SELECT *, CASE WHEN street <> '' THEN 's:' || street ELSE 't:' || path_type END AS key FROM e),
    g AS (SELECT *, CASE WHEN lag(key) OVER w = key THEN 0 ELSE 1 END AS fresh FROM f WINDOW w AS (PARTITION BY path_id ORDER BY edge_no)),
    h AS (SELECT *, sum(fresh) OVER (PARTITION BY path_id ORDER BY edge_no) AS step_no FROM g),
    s AS (SELECT path_id, step_no, arg_min(street, edge_no) AS street, arg_min(path_type, edge_no) AS path_type, sum(length) AS m, count(*) AS n, min(k) AS k1, max(k) + 1 AS k2 FROM h WHERE step_no <= 15 GROUP BY ALL)
    SELECT path_id, CAST(step_no AS BIGINT) AS step_no, street, path_type, CASE WHEN m / n >= 150 THEN 'long' ELSE 'short' END AS block_type,
      greatest(0.5, round(m / CASE WHEN m / n >= 150 THEN 201.17 ELSE 100.58 END * 2) / 2) AS blocks, round(CAST(m AS DOUBLE) / (3.0 * 1609.34 / 3600) / 60, 1) AS minutes,
      list_extract(['N','NE','E','SE','S','SW','W','NW'], CAST(round(((degrees(atan2((k2 * 2741 % 4200 - k1 * 2741 % 4200) / 10000.0 * cos(radians((41.64 + (k1 * 7919 % 3800) / 10000.0 + 41.64 + (k2 * 7919 % 3800) / 10000.0) / 2)),
        (k2 * 7919 % 3800 - k1 * 7919 % 3800) / 10000.0)) + 360) % 360) / 45) AS INTEGER) % 8 + 1) AS direction FROM s""")
def walk_steps(spark, sf_dir):
    return R.walk_steps(S.path_edges(spark, sf_dir)).drop("start_lat", "start_lon")


#: Three blocks up and three across, one pair for every 25th part.
WALK_PAIRS = """v_ask AS (SELECT p_partkey AS source, p_partkey + CASE WHEN p_partkey % 3 = 0 THEN 123 ELSE 77 END AS target FROM part WHERE p_partkey % 25 = 3
      AND p_partkey + CASE WHEN p_partkey % 3 = 0 THEN 123 ELSE 77 END IN (SELECT p_partkey FROM part)),
   v_arc AS (SELECT u, v, length::DOUBLE AS length, edge_id FROM v_edges UNION ALL SELECT v, u, length, edge_id FROM v_edges
      UNION ALL SELECT p_partkey, p_partkey, 0, NULL FROM part),
   v_reach(i, source, node, metres, hops, prev, edge_id) AS (
      SELECT 0, source, source, 0.0::DOUBLE, 0, NULL::BIGINT, NULL::BIGINT FROM (SELECT DISTINCT source FROM v_ask)
      UNION ALL SELECT i + 1, source, v, metres, hops, prev, edge_id FROM (SELECT *, row_number() OVER (PARTITION BY source, v
        ORDER BY metres, hops, prev NULLS FIRST, edge_id NULLS FIRST) AS best FROM (
          SELECT i, source, v, metres + length AS metres, CASE WHEN a.edge_id IS NULL THEN hops ELSE hops + 1 END AS hops,
            CASE WHEN a.edge_id IS NULL THEN prev ELSE u END AS prev, coalesce(a.edge_id, r.edge_id) AS edge_id
          FROM v_reach r JOIN v_arc a ON a.u = r.node WHERE i < 12 AND metres + length <= 0.75 * 1609.344)) WHERE best = 1),
   v_label AS (SELECT * FROM v_reach WHERE i = (SELECT max(i) FROM v_reach)),
   v_path(source, target, edge_no, u, v, edge_id, metres) AS (
      SELECT l.source, target, hops - 1, prev, node, edge_id, metres FROM v_label l JOIN v_ask a ON a.source = l.source AND a.target = l.node WHERE hops > 0
      UNION ALL SELECT p.source, target, hops - 1, prev, node, l.edge_id, l.metres FROM v_path p JOIN v_label l ON l.source = p.source AND l.node = p.u WHERE hops > 0)"""


def walk_pairs(spark, sf_dir):
    k, p = F.col("p_partkey"), S.table(spark, sf_dir, "part")
    target = k + F.when(k % 3 == 0, 123).otherwise(77)
    ask = p.where(k % 25 == 3).select(k.alias("source"), target.alias("target"))
    return ask.join(p.select(k.alias("target")), "target", "left_semi")


def found_paths(spark, sf_dir):
    e = R.clean_street_edges(S.street_edges_raw(spark, sf_dir))
    return W.street_paths(walk_pairs(spark, sf_dir), e, S.street_nodes(spark, sf_dir), 0.75), e


@query("street_paths", f"""WITH RECURSIVE {STREETS}, {WALK_PAIRS}
    SELECT source, target, edge_no, u, v, edge_id, metres FROM v_path""")
def street_paths(spark, sf_dir):
    return found_paths(spark, sf_dir)[0]


@query("street_steps", f"""WITH RECURSIVE {STREETS}, {WALK_PAIRS},
    e AS (SELECT source || '-' || target AS path_id, p.edge_no, name AS street, CASE WHEN name = '' AND (edge_id // 3) % 27 = 0 THEN 'crosswalk'
        WHEN highway = 'footway' THEN CASE WHEN (edge_id // 3) % 27 = 0 THEN 'crosswalk' ELSE 'footway' END
        WHEN (edge_id // 3) % 27 = 0 THEN 'crosswalk' ELSE '' END AS path_type, p.metres, e.length
      FROM v_path p JOIN v_edges e USING (edge_id)),
    f AS (SELECT *, CASE WHEN street <> '' THEN 's:' || street ELSE 't:' || path_type END AS key FROM e),
    g AS (SELECT *, CASE WHEN lag(key) OVER (PARTITION BY path_id ORDER BY edge_no) = key THEN 0 ELSE 1 END AS fresh FROM f),
    h AS (SELECT *, sum(fresh) OVER (PARTITION BY path_id ORDER BY edge_no) AS step_no FROM g),
    s AS (SELECT path_id, step_no, arg_min(street, edge_no) AS street, arg_min(path_type, edge_no) AS path_type, sum(length) AS m, count(*) AS n FROM h GROUP BY 1, 2)
    SELECT path_id, CAST(step_no AS BIGINT) AS step_no, street, path_type, CASE WHEN m / n >= 150 THEN 'long' ELSE 'short' END AS block_type,
      greatest(0.5, round(m / CASE WHEN m / n >= 150 THEN 201.17 ELSE 100.58 END * 2) / 2) AS blocks, round(CAST(m AS DOUBLE) / (3.0 * 1609.34 / 3600) / 60, 1) AS minutes
    FROM s WHERE step_no <= 15""")
def street_steps(spark, sf_dir):
    found, e = found_paths(spark, sf_dir)
    steps = R.walk_steps(W.directed_edges(found, e, S.street_nodes(spark, sf_dir)))
    return steps.select("path_id", "step_no", "street", "path_type", "block_type", "blocks", "minutes")
