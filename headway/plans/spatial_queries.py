"""Registered queries: spatial joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo
from ..operators import spatial as P
from ..sources import adapters as S
from .feed import Feed
from .registry import query
from .views import with_views

POINTS = """v_points AS (SELECT c_custkey AS point_id, 41.64 + (c_custkey * 6007 % 3800) / 10000.0 AS lat,
      -87.94 + (c_custkey * 15013 % 4200) / 10000.0 AS lon FROM customer),
   v_targets AS (SELECT p_partkey AS target_id, 41.64 + (p_partkey * 7919 % 3800) / 10000.0 AS lat,
      -87.94 + ((p_partkey * p_partkey * 31 + p_partkey * 17) % 4200) / 10000.0 AS lon FROM part)"""


def miles(a: str, b: str) -> str:
    return (f"(7917.6 * asin(sqrt(pow(sin((radians({b}.lat) - radians({a}.lat)) / 2), 2) + "
            f"cos(radians({a}.lat)) * cos(radians({b}.lat)) * pow(sin((radians({b}.lon) - radians({a}.lon)) / 2), 2))))")


PAIRS = POINTS + f""", v_pairs AS (SELECT p.point_id, p.lat, p.lon, t.target_id, {miles('p', 't')} AS miles
   FROM v_points p JOIN v_targets t ON abs(p.lat - t.lat) < 0.031 AND abs(p.lon - t.lon) < 0.042)"""


@query("radius_join", f"WITH {PAIRS} SELECT point_id, target_id, round(miles, 6) AS miles FROM v_pairs WHERE miles <= 0.5")
def radius_join(spark, sf_dir):
    j = P.radius_join(S.part_points(spark, sf_dir), S.customer_points(spark, sf_dir), 0.5, digits=6)
    return j.select("point_id", "target_id", "miles")


@query("nearest_within", f"""WITH {PAIRS} SELECT point_id, arg_min(target_id, struct_pack(m := miles, t := target_id)) AS target_id,
    round(min(miles), 6) AS miles FROM v_pairs WHERE miles <= 0.5 GROUP BY point_id""")
def nearest_within(spark, sf_dir):
    n = P.nearest_within(S.customer_points(spark, sf_dir), S.part_points(spark, sf_dir), 0.5, "target_id")
    return n.select("point_id", "target_id", F.round("miles", 6).alias("miles"))


@query("ring_nearest", f"""WITH {PAIRS},
    r AS (SELECT *, row_number() OVER w AS rank, min(miles) OVER (PARTITION BY point_id) AS m FROM v_pairs
          WHERE miles <= 2 WINDOW w AS (PARTITION BY point_id ORDER BY miles, target_id))
    SELECT point_id, target_id, rank, greatest(round(ceil(m * 4) / 4, 2), 0.25) AS ring, round(miles / 3.0 * 60.0, 1) AS walk_minutes
    FROM r WHERE rank <= 3 AND miles <= greatest(ceil(m * 4) / 4, 0.25)""")
def ring_nearest(spark, sf_dir):
    n = P.ring_nearest(S.customer_points(spark, sf_dir), S.part_points(spark, sf_dir), P.RAIL_RINGS, P.RAIL_K, "target_id")
    return n.select("point_id", "target_id", F.col("rank").cast("bigint").alias("rank"), "ring", "walk_minutes")


@query("ring_nearest_bus", f"""WITH {PAIRS},
    r AS (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY miles, target_id) AS rank FROM v_pairs WHERE miles <= 0.25)
    SELECT point_id, target_id, rank FROM r WHERE rank <= 5""")
def ring_nearest_bus(spark, sf_dir):
    n = P.ring_nearest(S.customer_points(spark, sf_dir), S.part_points(spark, sf_dir), P.bus_rings(), P.BUS_K, "target_id")
    return n.select("point_id", "target_id", F.col("rank").cast("bigint").alias("rank"))


@query("in_coverage", f"""WITH {POINTS} SELECT point_id,
    (lat BETWEEN 41.712 AND 42.019 AND lon BETWEEN -87.775 AND -87.52)
    OR (lat BETWEEN 42.019 AND 42.083 AND lon BETWEEN -87.71 AND -87.66) AS covered,
    lat BETWEEN 41.64 AND 42.02 AND lon BETWEEN -87.94 AND -87.52 AS in_city FROM v_points""")
def in_coverage(spark, sf_dir):
    lat, lon = F.col("lat"), F.col("lon")
    return S.customer_points(spark, sf_dir).select(
        "point_id", P.in_coverage(lat, lon).alias("covered"), P.in_city(lat, lon).alias("in_city"))


OD_CTE = """v_od AS (SELECT s_suppkey AS od_id, 41.64 + (s_suppkey * 7211 % 3800) / 10000.0 AS o_lat,
      -87.94 + (s_suppkey * 9973 % 4200) / 10000.0 AS o_lon,
      41.64 + (s_suppkey * 7211 % 3800) / 10000.0 + ((s_suppkey * 31) % 600 - 300) / 10000.0 AS d_lat,
      -87.94 + (s_suppkey * 9973 % 4200) / 10000.0 + ((s_suppkey * 17) % 600 - 300) / 10000.0 AS d_lon FROM supplier)"""


@query("same_place", f"""WITH {OD_CTE} SELECT count(*) AS pairs,
    count(CASE WHEN pow(o_lat - d_lat, 2) + pow(o_lon - d_lon, 2) < 0.001 * 0.001 THEN 1 END) AS rejected FROM v_od""")
def same_place(spark, sf_dir):
    od = S.od_pairs(spark, sf_dir)
    one = lambda df, a, b: df.select(F.lit(a).alias("pairs"), F.lit(b).alias("rejected"))
    both = one(od, 1, 0).unionByName(one(P.same_place(od), 0, 1))
    return both.agg(F.sum("pairs").alias("pairs"), F.sum("rejected").alias("rejected"))


@query("intermodal_edges", with_views(["v_stops"], f"""
    SELECT CAST(from_id AS VARCHAR) AS from_id, CAST(to_id AS VARCHAR) AS to_id, round(minutes, 6) AS minutes FROM (
      SELECT from_id, to_id, greatest(miles / 3.0 * 60.0 * 1.29, 3.0) AS minutes FROM v_near WHERE miles <= 0.15
      UNION ALL SELECT to_id, from_id, greatest(miles / 3.0 * 60.0 * 1.29, 3.0) FROM v_near WHERE miles <= 0.15)
    WHERE minutes <= 5""", f"""v_near AS (SELECT s.stop_id AS from_id, b.stop_id AS to_id, {miles('b', 's')} AS miles
    FROM v_stops s JOIN v_stops b ON s.kind = 'station' AND b.kind = 'bus'
     AND abs(s.lat - b.lat) < 0.01 AND abs(s.lon - b.lon) < 0.01)"""))
def intermodal_edges(spark, sf_dir):
    st = Feed.from_tables(spark, sf_dir).stops
    e = P.intermodal_edges(st.where(F.col("kind") == "station"), st.where(F.col("kind") == "bus"))
    return e.withColumn("minutes", F.round("minutes", 6))


EXITS = f"""v_ent AS (SELECT p_partkey AS entrance_id, CASE WHEN p_partkey % 5 = 0 THEN '' ELSE 'Exit ' || p_brand END AS label,
      41.64 + ((p_partkey // 4 * 4) * 7919 % 3800) / 10000.0 + (p_partkey % 7) / 2000.0 AS lat,
      -87.94 + (((p_partkey // 4 * 4) * (p_partkey // 4 * 4) * 31 + (p_partkey // 4 * 4) * 17) % 4200) / 10000.0 + (p_partkey % 5) / 2000.0 AS lon FROM part),
    v_exits AS (SELECT CAST(s.stop_id AS VARCHAR) AS station_id, e.entrance_id, e.lat, e.lon,
        CASE WHEN e.label = '' THEN printf('Entrance (%.4f, %.4f)', e.lat, e.lon) ELSE e.label END AS label, {miles('e', 's')} AS miles
      FROM v_ent e JOIN v_stops s ON s.kind = 'station' AND abs(s.lat - e.lat) < 0.01 AND abs(s.lon - e.lon) < 0.01
      WHERE {miles('e', 's')} <= 0.2
      QUALIFY row_number() OVER (PARTITION BY entrance_id ORDER BY {miles('e', 's')}, CAST(s.stop_id AS VARCHAR)) = 1)"""


def exits(spark, sf_dir):
    st = Feed.from_tables(spark, sf_dir).stops.where(F.col("kind") == "station")
    return P.exits_per_station(S.entrances(spark, sf_dir), st)


@query("exits_per_station", with_views(["v_stops"], """
    SELECT station_id, row_number() OVER (PARTITION BY station_id ORDER BY lower(label), entrance_id) AS exit_no,
           entrance_id, label FROM v_exits""", EXITS))
def exits_per_station(spark, sf_dir):
    return exits(spark, sf_dir).select("station_id", F.col("exit_no").cast("bigint").alias("exit_no"), "entrance_id", "label")


@query("busiest_stations", with_views(["v_stops"], """
    SELECT station_id, count(*) AS exits FROM v_exits GROUP BY 1 ORDER BY exits DESC, station_id LIMIT 15""", EXITS))
def busiest_stations(spark, sf_dir):
    return P.busiest_stations(exits(spark, sf_dir))


WAYS = """v_ways AS (SELECT c_custkey AS k, 'elm' || (c_custkey % 50) AS canon,
      CASE c_custkey % 4 WHEN 0 THEN 'N ' WHEN 1 THEN 'West ' WHEN 2 THEN '' ELSE 'SE ' END || 'Elm' || (c_custkey % 50)
       || CASE c_custkey % 3 WHEN 0 THEN ' St' WHEN 1 THEN ' Avenue' ELSE ' Blvd' END AS raw,
      41.64 + (c_custkey * 6007 % 3800) / 10000.0 AS la, -87.94 + (c_custkey * 15013 % 4200) / 10000.0 AS lo FROM customer),
   v_segs AS (SELECT canon, raw, la AS y1, lo AS x1, la + ((k * 13) % 160 - 80) / 10000.0 AS y2, lo + ((k * 29) % 160 - 80) / 10000.0 AS x2 FROM v_ways
      UNION ALL SELECT canon, raw, la + ((k * 13) % 160 - 80) / 10000.0, lo + ((k * 29) % 160 - 80) / 10000.0,
        la + ((k * 37) % 240 - 120) / 10000.0, lo + ((k * 53) % 240 - 120) / 10000.0 FROM v_ways),
   v_x AS (SELECT a.canon AS name_a, b.canon AS name_b, a.raw AS raw_a, b.raw AS raw_b, a.x1, a.y1,
        a.x2 - a.x1 AS rx, a.y2 - a.y1 AS ry, b.x2 - b.x1 AS sx, b.y2 - b.y1 AS sy, b.x1 - a.x1 AS qx, b.y1 - a.y1 AS qy
      FROM v_segs a JOIN v_segs b ON a.canon < b.canon AND abs(a.x1 - b.x1) < 0.05 AND abs(a.y1 - b.y1) < 0.05),
   v_cross AS (SELECT name_a, name_b, raw_a, raw_b, x1 + t * rx AS x, y1 + t * ry AS y FROM (
      SELECT *, (qx * sy - qy * sx) / (rx * sy - ry * sx) AS t, (qx * ry - qy * rx) / (rx * sy - ry * sx) AS u
      FROM v_x WHERE rx * sy - ry * sx <> 0) WHERE t BETWEEN 0 AND 1 AND u BETWEEN 0 AND 1),
   v_intersections AS (SELECT name_a, name_b, CAST(round(y * 100000) AS BIGINT) AS lat_q, CAST(round(x * 100000) AS BIGINT) AS lon_q,
      min(raw_a) AS raw_a, min(raw_b) AS raw_b FROM v_cross GROUP BY ALL)"""


@query("crossing_streets", f"WITH {WAYS} SELECT * FROM v_intersections")
def crossing_streets(spark, sf_dir):
    return P.crossing_streets(S.ways(spark, sf_dir)).drop("lat", "lon")


@query("best_exit", with_views(["v_stops"], f"""
    SELECT l.od_id, l.station_id, arg_min(e.label, struct_pack(m := {miles('e', 'l')}, l := e.label)) AS exit_label,
           round(min({miles('e', 'l')}) / 3.0 * 60.0, 1) AS walk_minutes
    FROM v_legs l LEFT JOIN v_exits e ON e.station_id = l.station_id GROUP BY ALL""", EXITS + """,
    v_legs AS (SELECT s_suppkey AS od_id, CAST(40000 + s_suppkey % 10000 AS VARCHAR) AS station_id,
        41.64 + (s_suppkey * 7211 % 3800) / 10000.0 + ((s_suppkey * 31) % 600 - 300) / 10000.0 AS lat,
        -87.94 + (s_suppkey * 9973 % 4200) / 10000.0 + ((s_suppkey * 17) % 600 - 300) / 10000.0 AS lon FROM supplier)"""))
def best_exit(spark, sf_dir):
    legs = S.od_pairs(spark, sf_dir).withColumn("station_id", (F.col("od_id") % 10000 + 40000).cast("string"))
    return P.best_exit(legs, exits(spark, sf_dir)).select("od_id", "station_id", "exit_label", "walk_minutes")


@query("headings", f"""WITH {OD_CTE}, b AS (SELECT *, radians(d_lon - o_lon) AS dl, radians(o_lat) AS p1, radians(d_lat) AS p2 FROM v_od),
    c AS (SELECT *, (degrees(atan2(sin(dl) * cos(p2), cos(p1) * sin(p2) - sin(p1) * cos(p2) * cos(dl))) + 360) % 360 AS brg,
      (degrees(atan2((d_lon - o_lon) * cos(radians((o_lat + d_lat) / 2)), d_lat - o_lat)) + 360) % 360 AS flat FROM b)
    SELECT od_id, CASE WHEN brg < 45 OR brg >= 315 THEN 'Northbound' WHEN brg < 135 THEN 'Eastbound'
        WHEN brg < 225 THEN 'Southbound' ELSE 'Westbound' END AS cardinal,
      list_extract(['N','NE','E','SE','S','SW','W','NW'], CAST(round(flat / 45) AS INTEGER) % 8 + 1) AS heading FROM c""")
def headings(spark, sf_dir):
    c = [F.col(x) for x in ("o_lat", "o_lon", "d_lat", "d_lon")]
    return S.od_pairs(spark, sf_dir).select(
        "od_id", geo.cardinal(geo.bearing(*c)).alias("cardinal"), geo.heading8(*c).alias("heading"))
