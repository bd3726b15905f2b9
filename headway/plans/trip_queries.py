"""Registered queries: itineraries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import itinerary as I
from ..sources import adapters as S
from ..functions.timecode import service_period
from ..operators import network as N
from ..operators.spatial import BUS_K, RAIL_K, RAIL_RINGS, bus_rings, intermodal_edges, ring_nearest
from ..session import save_table
from .analytics_queries import array_text
from .feed import Feed
from .network_queries import HOPS
from .registry import query
from .spatial_queries import miles
from .trips import TripNetwork, plan_trips, weather_pace
from .views import LINES, with_views


def od_pairs(spark, sf_dir):
    k = F.col("od_id")
    minute = F.make_interval(mins=(k * 97 % 1440).cast("int"), days=(k % 7).cast("int"))
    return S.od_pairs(spark, sf_dir).withColumn("depart", F.lit("2024-01-08 00:00:00").cast("timestamp_ntz") + minute)


def bus_sequences(spark, sf_dir, feed, net):
    """Buses of every period, each for the trips of its own."""
    bus = feed.rep_stops.where(F.col("mode") == "bus")
    return bus.join(net.stops.select("stop_id", "lat", "lon"), "stop_id").select(
        "period", "route_id", "direction_id", "pos", "stop_id", "lat", "lon", "arr_min")


def bus_arrivals(sequences):
    """One arrival per (stop, line) of the timetable; waits from the trip number."""
    return sequences.where(F.col("mode") == "bus").groupBy("stop_id", F.col("route_id").alias("line_code")).agg(
        F.min(F.col("trip_id").cast("bigint") % 15).cast("int").alias("minutes"))


@query("plan_trips")
def trips(spark, sf_dir):
    """Origin-destination table to ranked itineraries, all stages."""
    feed = Feed.from_tables(spark, sf_dir)
    net = TripNetwork.build(feed)
    found, _ = plan_trips(od_pairs(spark, sf_dir), net, arrivals=bus_arrivals(feed.saved_sequences),
                          sequences=bus_sequences(spark, sf_dir, feed, net))
    return found.select("od_id", "rank", "signature", "transfers", F.round("total", 3).alias("total"),
                        F.to_json("legs").alias("legs"))


@query("trip_status")
def trip_status(spark, sf_dir):
    net = TripNetwork.build(Feed.from_tables(spark, sf_dir))
    return plan_trips(od_pairs(spark, sf_dir), net)[1]


DEPART = """v_od AS (SELECT s_suppkey AS od_id, 41.64 + (s_suppkey * 7211 % 3800) / 10000.0 AS o_lat, -87.94 + (s_suppkey * 9973 % 4200) / 10000.0 AS o_lon,
      41.64 + (s_suppkey * 7211 % 3800) / 10000.0 + ((s_suppkey * 31) % 600 - 300) / 10000.0 AS d_lat,
      -87.94 + (s_suppkey * 9973 % 4200) / 10000.0 + ((s_suppkey * 17) % 600 - 300) / 10000.0 AS d_lon, s_suppkey * 97 % 1440 AS m,
      CASE WHEN s_suppkey * 97 % 1440 >= 1320 OR s_suppkey * 97 % 1440 < 300 THEN 'owl' WHEN s_suppkey % 7 >= 5 THEN 'weekend'
       WHEN s_suppkey * 97 % 1440 BETWEEN 360 AND 569 OR s_suppkey * 97 % 1440 BETWEEN 930 AND 1139 THEN 'weekday_peak'
       WHEN s_suppkey * 97 % 1440 BETWEEN 1140 AND 1319 THEN 'weekday_evening' ELSE 'weekday_midday' END AS period FROM supplier)"""
ENDS = """v_ends AS (SELECT od_id, 'o' AS side, o_lat AS lat, o_lon AS lon FROM v_od UNION ALL SELECT od_id, 'd', d_lat, d_lon FROM v_od)"""
SHRINK = "41.64 + ({0}lat - 41.64) / 5 AS {0}lat, -87.94 + ({0}lon + 87.94) / 5 AS {0}lon"
DENSE = (DEPART.replace("v_od AS", "v_od0 AS") + f", v_od AS (SELECT * REPLACE ({SHRINK.format('o_')}, {SHRINK.format('d_')}) FROM v_od0), "
         f"v_dense AS (SELECT * REPLACE ({SHRINK.format('')}) FROM v_stops), " + ENDS)
REACH = f"""v_dist AS (SELECT e.od_id, e.side, s.kind, CAST(s.stop_id AS VARCHAR) AS stop_id, {miles('e', 's')} AS miles FROM v_ends e JOIN v_stops s
      ON s.kind IN ('station', 'bus') AND abs(s.lat - e.lat) < 0.031 AND abs(s.lon - e.lon) < 0.042),
   v_ranked AS (SELECT *, row_number() OVER (PARTITION BY od_id, side, kind ORDER BY miles, stop_id) AS r, min(miles) OVER (PARTITION BY od_id, side, kind) AS m
      FROM v_dist WHERE miles <= CASE kind WHEN 'station' THEN 2 ELSE 0.25 END),
   v_reach AS (SELECT od_id, side, kind, stop_id, round(miles / 3.0 * 60, 1) AS w FROM v_ranked
      WHERE r <= CASE kind WHEN 'station' THEN 3 ELSE 5 END AND (kind = 'bus' OR miles <= greatest(ceil(m * 4) / 4, 0.25)))"""


def shrink(df, *prefixes):
    """The same places on a fifth of the extent, so that lines meet."""
    for p in prefixes or ("",):
        df = df.withColumn(f"{p}lat", F.lit(41.64) + (F.col(f"{p}lat") - 41.64) / 5).withColumn(
            f"{p}lon", F.lit(-87.94) + (F.col(f"{p}lon") + 87.94) / 5)
    return df


def reach(od, stops, side):
    """Rail and bus stops around one end of every pair."""
    p = od.select("od_id", F.col(f"{side}_lat").alias("lat"), F.col(f"{side}_lon").alias("lon"))
    at = lambda kind: stops.where(F.col("kind") == kind).select("stop_id", "lat", "lon")
    cols = ["od_id", "stop_id", "walk_minutes"]
    rail = ring_nearest(p, at("station"), RAIL_RINGS, RAIL_K).select(*cols, F.lit("rail").alias("mode"))
    return rail.unionByName(ring_nearest(p, at("bus"), bus_rings(), BUS_K).select(*cols, F.lit("bus").alias("mode")))


@query("itineraries", with_views(["v_rep_stops", "v_stops"], """
    SELECT od_id, rank, signature, transfers, round(total, 4) AS total FROM (SELECT *, row_number() OVER (PARTITION BY od_id ORDER BY total, signature) AS rank FROM v_best) WHERE rank <= 5""",
    HOPS.replace("v_ends", "v_bus_ends") + f""", {DEPART}, {ENDS}, {REACH},
   v_fast AS (SELECT a.period, a.route_id, CAST(a.stop_id AS VARCHAR) AS board, CAST(b.stop_id AS VARCHAR) AS alight,
        min(CASE WHEN b.dep_min < a.dep_min THEN b.dep_min - a.dep_min + 1440 ELSE b.dep_min - a.dep_min END) AS ride
      FROM v_rep_stops a JOIN v_rep_stops b USING (period, trip_id) WHERE a.pos < b.pos AND a.stop_id <> b.stop_id AND a.dep_min <> b.dep_min GROUP BY ALL),
   v_moves AS (SELECT p.period, CAST(from_id AS VARCHAR) AS a, CAST(to_id AS VARCHAR) AS b, minutes AS w FROM v_transfers t CROSS JOIN (SELECT DISTINCT period FROM v_rep_stops) p
        WHERE NOT EXISTS (SELECT 1 FROM v_hops h WHERE h.period = p.period AND h.from_id = t.from_id AND h.to_id = t.to_id)
      UNION ALL SELECT p.period, CAST(from_id AS VARCHAR), CAST(to_id AS VARCHAR), minutes FROM v_walk CROSS JOIN (SELECT DISTINCT period FROM v_rep_stops) p),
   v_b0 AS (SELECT od_id, period, stop_id, NULL AS route, '' AS sig, w AS cost, [stop_id] AS seen FROM v_reach JOIN v_od USING (od_id) WHERE side = 'o'),
   v_r1 AS (SELECT od_id, b.period, alight AS stop_id, route_id AS route, route_id || ':' || board || '>' || alight AS sig, cost + ride AS cost, list_append(seen, alight) AS seen
      FROM v_b0 b JOIN v_fast f ON f.period = b.period AND f.board = b.stop_id AND NOT list_contains(seen, alight)),
   v_b1 AS (SELECT od_id, period, stop_id, route, sig, cost + 6 AS cost, seen FROM v_r1 UNION ALL
      SELECT od_id, r.period, b, route, sig, cost + w + 3, list_append(seen, b) FROM v_r1 r JOIN v_moves m ON m.period = r.period AND m.a = r.stop_id AND NOT list_contains(seen, b)),
   v_r2 AS (SELECT od_id, b.period, alight AS stop_id, route_id AS route, sig || '|' || route_id || ':' || board || '>' || alight AS sig, cost + ride AS cost, list_append(seen, alight) AS seen
      FROM v_b1 b JOIN v_fast f ON f.period = b.period AND f.board = b.stop_id AND route <> route_id AND NOT list_contains(seen, alight)),
   v_b2 AS (SELECT od_id, period, stop_id, route, sig, cost + 6 AS cost, seen FROM v_r2 UNION ALL
      SELECT od_id, r.period, b, route, sig, cost + w + 3, list_append(seen, b) FROM v_r2 r JOIN v_moves m ON m.period = r.period AND m.a = r.stop_id AND NOT list_contains(seen, b)),
   v_r3 AS (SELECT od_id, b.period, alight AS stop_id, route_id AS route, sig || '|' || route_id || ':' || board || '>' || alight AS sig, cost + ride AS cost, list_append(seen, alight) AS seen
      FROM v_b2 b JOIN v_fast f ON f.period = b.period AND f.board = b.stop_id AND route <> route_id AND NOT list_contains(seen, alight)),
   v_all AS (SELECT od_id, stop_id, sig, cost, 0 AS transfers FROM v_b0 UNION ALL SELECT od_id, stop_id, sig, cost, 0 FROM v_r1
      UNION ALL SELECT od_id, stop_id, sig, cost, 1 FROM v_r2 UNION ALL SELECT od_id, stop_id, sig, cost, 2 FROM v_r3),
   v_best AS (SELECT a.od_id, a.sig AS signature, a.transfers, min(a.cost + e.w) AS total FROM v_all a JOIN v_reach e ON e.od_id = a.od_id AND e.side = 'd' AND e.stop_id = a.stop_id GROUP BY ALL)"""))
def itineraries(spark, sf_dir):
    """The bulk search checked against the same rounds without any pruning."""
    net = TripNetwork.build(Feed.from_tables(spark, sf_dir))
    od = od_pairs(spark, sf_dir).withColumn("period", service_period(F.col("depart")))
    found = I.itineraries(od, reach(od, net.stops, "o"), reach(od, net.stops, "d"), net.rides, net.walks)
    return found.select("od_id", F.col("rank").cast("bigint").alias("rank"), "signature", "transfers", F.round("total", 4).alias("total"))


DENSE_SQL = with_views(["v_trip_stops", "v_stops"], """
    SELECT od_id, rank, signature, transfers, round(total, 4) AS total FROM (SELECT *, row_number() OVER (PARTITION BY od_id ORDER BY total, signature) AS rank FROM v_best) WHERE rank <= 3""",
    f"""{DENSE}, {REACH.replace('v_stops', 'v_dense')},
   v_fast AS (SELECT a.route_id, CAST(a.stop_id AS VARCHAR) AS board, CAST(b.stop_id AS VARCHAR) AS alight, CAST(min(b.dep_min - a.dep_min) AS DOUBLE) AS ride
      FROM v_trip_stops a JOIN v_trip_stops b USING (trip_id) WHERE a.pos < b.pos AND a.stop_id <> b.stop_id AND b.dep_min > a.dep_min GROUP BY ALL),
   v_near AS (SELECT CAST(s.stop_id AS VARCHAR) AS a, CAST(b.stop_id AS VARCHAR) AS b, greatest({miles('b', 's')} / 3.0 * 60.0 * 1.29, 3.0) AS w FROM v_dense s JOIN v_dense b
        ON s.kind = 'station' AND b.kind = 'bus' AND abs(s.lat - b.lat) < 0.01 AND abs(s.lon - b.lon) < 0.01 WHERE {miles('b', 's')} <= 0.15),
   v_moves AS (SELECT a, b, w FROM v_near WHERE w <= 5 UNION ALL SELECT b, a, w FROM v_near WHERE w <= 5),
   v_b0 AS (SELECT od_id, stop_id, w AS cost, w * 1.5 AS c, [stop_id] AS seen FROM v_reach WHERE side = 'o'),
   v_r1 AS (SELECT od_id, alight AS stop_id, route_id AS route, route_id || ':' || board || '>' || alight AS sig, c + ride AS c, list_append(seen, alight) AS seen
      FROM v_b0 b JOIN v_fast f ON f.board = b.stop_id AND NOT list_contains(seen, alight)),
   v_b1 AS (SELECT od_id, stop_id, route, sig, c + 3 * 1.5 + 3 AS c, seen FROM v_r1 UNION ALL
      SELECT od_id, b, route, sig, c + w * 1.5 + 3, list_append(seen, b) FROM v_r1 r JOIN v_moves m ON m.a = r.stop_id AND NOT list_contains(seen, b)),
   v_r2 AS (SELECT od_id, alight AS stop_id, sig || '|' || route_id || ':' || board || '>' || alight AS sig, c + ride AS c
      FROM v_b1 b JOIN v_fast f ON f.board = b.stop_id AND route <> route_id AND NOT list_contains(seen, alight)),
   v_all AS (SELECT od_id, stop_id, '' AS sig, c, 0 AS transfers FROM v_b0 UNION ALL SELECT od_id, stop_id, sig, c, 0 FROM v_r1 UNION ALL SELECT od_id, stop_id, sig, c, 1 FROM v_r2),
   v_best AS (SELECT a.od_id, a.sig AS signature, a.transfers, min(a.c + e.w * 1.5) AS total FROM v_all a JOIN v_reach e ON e.od_id = a.od_id AND e.side = 'd' AND e.stop_id = a.stop_id GROUP BY ALL)""")


@query("itineraries_dense", DENSE_SQL)
def itineraries_dense(spark, sf_dir):
    """All trips as rides in one period, one change, slow walking, places drawn closer."""
    return dense_itineraries(spark, sf_dir, shrink(od_pairs(spark, sf_dir), "o_", "d_"))


def dense_itineraries(spark, sf_dir, od):
    feed = Feed.from_tables(spark, sf_dir)
    stops = save_table(shrink(feed.stops), "stops")
    seq = feed.saved_sequences.withColumn("period", F.lit("all"))
    rides = N.rides(seq).withColumn("line", F.col("route_id"))
    near = intermodal_edges(stops.where(F.col("kind") == "station"), stops.where(F.col("kind") == "bus"))
    od = od.withColumn("period", F.lit("all"))
    found = I.itineraries(od, reach(od, stops, "o"), reach(od, stops, "d"), rides,
                          near.withColumn("period", F.lit("all")), k=3, max_transfers=1, walk_factor=1.5)
    return found.select("od_id", F.col("rank").cast("bigint").alias("rank"), "signature", "transfers", F.round("total", 4).alias("total"))


WEATHER = """v_fc AS (SELECT s_suppkey % 3 AS cell, TIMESTAMP '2024-01-08' + to_minutes(s_suppkey % 7 * 1440 + s_suppkey * 97 % 1440 - s_suppkey % 50) AS fts,
      s_suppkey % 4 AS kind, s_suppkey % 3 AS grade, s_suppkey % 60 AS gust, s_suppkey % 90 - 20 AS feels FROM supplier),
   v_one AS (SELECT cell, fts, max(kind) AS kind, max(grade) AS grade, max(gust) AS gust, max(feels) AS feels FROM v_fc GROUP BY 1, 2 HAVING count(*) = 1),
   v_ask AS (SELECT s_suppkey AS od_id, s_suppkey % 3 AS cell, TIMESTAMP '2024-01-08' + to_minutes(s_suppkey % 7 * 1440 + s_suppkey * 97 % 1440) AS begun FROM supplier),
   v_pace AS (SELECT od_id, CASE WHEN fts >= begun - INTERVAL 30 MINUTE THEN 1.0::DOUBLE / greatest(0.60, CASE kind WHEN 0 THEN 1.0 WHEN 1 THEN list_extract([0.96, 0.90, 0.82], grade + 1)
      WHEN 2 THEN list_extract([0.92, 0.84, 0.74], grade + 1) ELSE 0.78 END::DOUBLE * CASE WHEN gust > 35 THEN 0.90 ELSE 1.0 END::DOUBLE * CASE WHEN feels < 0 THEN 0.88 ELSE 1.0 END::DOUBLE)
      ELSE 1.0 END AS f FROM v_ask a ASOF LEFT JOIN v_one w ON a.cell = w.cell AND a.begun >= w.fts)"""


def paced_pairs(spark, sf_dir):
    """The pairs with their pace; forecasts of one instant and cell are left out."""
    fc = S.trip_forecasts(spark, sf_dir)
    fc = fc.join(fc.groupBy("lat", "ts").count().where("count = 1").drop("count"), ["lat", "ts"])
    at = S.cell_of(F.col("od_id"))
    od = od_pairs(spark, sf_dir).withColumn("w_lat", at[0]).withColumn("w_lon", at[1])
    return weather_pace(od, fc, "w_lat", "w_lon").drop("w_lat", "w_lon")


@query("weather_pace", f"WITH {WEATHER} SELECT od_id, round(f, 6) AS walk_factor FROM v_pace")
def trip_pace(spark, sf_dir):
    return paced_pairs(spark, sf_dir).select("od_id", F.round("walk_factor", 6).alias("walk_factor"))


@query("itineraries_weather", DENSE_SQL.replace("v_b0 AS", WEATHER + ",\n   v_b0 AS").replace(
    "w * 1.5 AS c, [stop_id] AS seen FROM v_reach", "w * f AS c, [stop_id] AS seen, f FROM v_reach JOIN v_pace USING (od_id)").replace(
    "list_append(seen, alight) AS seen", "list_append(seen, alight) AS seen, f").replace("c + 3 * 1.5 + 3 AS c, seen FROM", "c + 3 * f + 3 AS c, seen, f FROM").replace(
    "c + w * 1.5 + 3, list_append(seen, b) FROM", "c + w * f + 3, list_append(seen, b), f FROM").replace("min(a.c + e.w * 1.5)", "min(a.c + e.w * p.f)").replace(
    "e.stop_id = a.stop_id GROUP BY", "e.stop_id = a.stop_id JOIN v_pace p ON p.od_id = a.od_id GROUP BY"))
def itineraries_weather(spark, sf_dir):
    """As itineraries_dense, each pair walking at the pace of its weather."""
    return dense_itineraries(spark, sf_dir, shrink(paced_pairs(spark, sf_dir), "o_", "d_"))


@query("bus_bus", with_views(["v_trip_stops", "v_stops"], """
    SELECT od_id, rank, signature, round(total, 4) AS total FROM (SELECT *, row_number() OVER (PARTITION BY od_id ORDER BY total, signature) AS rank FROM v_timed WHERE total <= 90) WHERE rank <= 2""",
    f"""{DENSE}, {REACH.replace('v_stops', 'v_dense')},
   v_seq AS (SELECT t.route_id AS route, CAST(t.trip_id AS VARCHAR) AS dir, t.pos, CAST(t.stop_id AS VARCHAR) AS stop, s.lat, s.lon, t.dep_min AS m
      FROM v_trip_stops t JOIN v_dense s USING (stop_id) WHERE t.mode = 'bus'),
   v_place AS (SELECT DISTINCT stop, lat, lon FROM v_seq),
   v_exit AS (SELECT o.od_id, q.route, q.dir, q.pos, q.stop, q.m, p.x FROM (SELECT o.od_id, p.stop, {miles('p', 'o')} AS x FROM (SELECT od_id, d_lat AS lat, d_lon AS lon FROM v_od) o
      JOIN v_place p ON abs(p.lat - o.lat) < 0.01 AND abs(p.lon - o.lon) < 0.012) p JOIN v_od o USING (od_id) JOIN v_seq q ON q.stop = p.stop WHERE x <= 0.5),
   v_second AS (SELECT e.od_id, t.route, t.dir, t.stop AS t_stop, t.m AS t_min, arg_min(struct_pack(x := e.x, pos := e.pos, stop := e.stop, m := e.m), struct_pack(x := e.x, p := -e.pos)) AS e
      FROM v_exit e JOIN v_seq t ON t.route = e.route AND t.dir = e.dir AND t.pos < e.pos GROUP BY e.od_id, t.route, t.dir, t.pos, t.stop, t.m),
   v_close AS (SELECT a.stop AS sk, b.stop AS t, {miles('a', 'b')} AS c FROM v_place a JOIN v_place b ON abs(a.lat - b.lat) < 0.005 AND abs(a.lon - b.lon) < 0.006 WHERE {miles('a', 'b')} <= 0.25),
   v_arr AS (SELECT stop AS s, route, min(CAST(dir AS BIGINT) % 15) AS wait FROM v_seq GROUP BY ALL),
   v_first AS (SELECT r.od_id, r.w, a.wait, a.route, q.dir, q.pos, q.stop, q.m, o.d_lat, o.d_lon, {miles('q', 'dd')} AS bm
      FROM v_reach r JOIN v_arr a ON a.s = r.stop_id JOIN v_seq q ON q.stop = r.stop_id AND q.route = a.route JOIN v_od o ON o.od_id = r.od_id
      JOIN (SELECT od_id, d_lat AS lat, d_lon AS lon FROM v_od) dd ON dd.od_id = r.od_id WHERE r.side = 'o' AND r.kind = 'bus'),
   v_fwd AS (SELECT f.*, k.pos AS sk_pos, k.stop AS sk, k.m AS sk_min FROM v_first f JOIN v_seq k ON k.route = f.route AND k.dir = f.dir AND k.pos > f.pos
      JOIN (SELECT od_id, d_lat AS lat, d_lon AS lon FROM v_od) dd ON dd.od_id = f.od_id WHERE {miles('k', 'dd')} < f.bm * 0.9),
   v_cand AS (SELECT f.*, s.route AS rb, s.dir AS db, s.t_stop, s.t_min, s.e, n.c, f.w + f.wait + (n.c + s.e.x) * 25.8 AS score
      FROM v_fwd f JOIN v_close n ON n.sk = f.sk JOIN v_second s ON s.od_id = f.od_id AND s.t_stop = n.t AND (s.route <> f.route OR s.dir <> f.dir)),
   v_three AS (SELECT * FROM v_cand QUALIFY row_number() OVER (PARTITION BY od_id, stop, route, dir ORDER BY score, sk_pos, t_stop, rb, db, e.pos) <= 3),
   v_one AS (SELECT * FROM v_three QUALIFY row_number() OVER (PARTITION BY od_id, route, dir, sk_pos, t_stop, rb, db, e.pos ORDER BY score, stop) = 1),
   v_timed AS (SELECT od_id, route || ':' || stop || '>' || sk || '|' || rb || ':' || t_stop || '>' || e.stop AS signature,
      (sk_min - m + 1440) % 1440 + (e.m - t_min + 1440) % 1440 + w + CASE WHEN sk = t_stop THEN 0 ELSE greatest(round(c / 3.0 * 60, 1), 3) END + round(e.x / 3.0 * 60, 1) + wait + 3 AS total FROM v_one)"""))
def bus_bus(spark, sf_dir):
    """Every bus trip is a sequence of its own, so that many lines can be combined."""
    feed = Feed.from_tables(spark, sf_dir)
    stops, od = save_table(shrink(feed.stops), "stops"), shrink(od_pairs(spark, sf_dir), "o_", "d_")
    seq = feed.saved_sequences.where(F.col("mode") == "bus").withColumn("direction_id", F.col("trip_id")).join(
        stops.select("stop_id", "lat", "lon"), "stop_id")
    access = reach(od, stops, "o").where(F.col("mode") == "bus")
    b = I.bus_bus(od, access, bus_arrivals(feed.saved_sequences), seq)
    return b.select("od_id", F.col("rank").cast("bigint").alias("rank"), "signature", F.round("total", 4).alias("total"))


ITINS = f"""v_legs AS (SELECT l_orderkey AS od_id, ln AS leg_no, p FROM {LINES}),
   v_kind AS (SELECT *, p % 5 = 0 AS walk, CASE WHEN p % 3 = 0 THEN 'rail' ELSE 'bus' END AS mode, 'R' || (p % 40) AS route_id, CAST(p % 17 AS DOUBLE) AS minutes FROM v_legs),
   v_itin AS (SELECT od_id, coalesce(string_agg(route_id || ':' || p, '|' ORDER BY leg_no) FILTER (NOT walk), '') AS signature,
      greatest(count(CASE WHEN NOT walk THEN 1 END) - 1, 0) AS transfers, coalesce(sum(minutes) FILTER (NOT walk), 0) AS transit, coalesce(sum(minutes) FILTER (walk), 0) AS walks,
      arg_min(CASE WHEN walk THEN minutes ELSE 0 END, leg_no) AS access, bool_or(NOT walk AND mode = 'rail') AS rail,
      list(CASE WHEN p % 4 = 0 THEN NULL ELSE p % 11 END ORDER BY leg_no) FILTER (NOT walk) AS waits FROM v_kind GROUP BY od_id)"""


def itins(spark, sf_dir):
    """Itineraries made of line items: one per order, legs by line number."""
    p = F.col("p")
    walk = p % 5 == 0
    li = S.call_lines(spark, sf_dir).select(F.col("l_orderkey").alias("od_id"), F.col("ln").alias("leg_no"), "p")
    none = F.lit(None).cast("string")
    one = F.struct(
        "leg_no", walk.alias("walk"), p.alias("p"),
        F.struct(F.when(walk, "walk").otherwise("transit").alias("leg_type"),
                 F.when(walk, "walk").when(p % 3 == 0, "rail").otherwise("bus").alias("mode"),
                 F.when(walk, none).otherwise(F.concat(F.lit("R"), p % 40)).alias("route_id"),
                 F.when(walk, none).otherwise(F.concat(F.lit("R"), p % 40)).alias("line"),
                 F.when(walk, "origin").otherwise("x").alias("from_id"), p.cast("string").alias("to_id"),
                 (p % 17).cast("double").alias("minutes")).alias("leg"))
    g = li.groupBy("od_id").agg(F.sort_array(F.collect_list(one)).alias("a"))
    rides = F.filter("a", lambda x: ~x["walk"])
    walks = F.filter("a", lambda x: x["walk"])
    add = lambda arr: F.aggregate(arr, F.lit(0.0), lambda s, x: s + x["leg"]["minutes"])
    return g.select(
        "od_id", F.array_join(F.transform(rides, lambda x: F.concat(x["leg"]["route_id"], F.lit(":"), x["p"])), "|").alias("signature"),
        F.greatest(F.size(rides) - 1, F.lit(0)).alias("transfers"), add(rides).alias("transit_minutes"), add(walks).alias("walk_minutes"),
        F.lit(0.0).alias("total"), F.transform("a", lambda x: x["leg"]).alias("legs"),
        F.slice(F.transform(rides, lambda x: F.when(x["p"] % 4 == 0, F.lit(None)).otherwise(x["p"] % 11)), 2, 99).alias("live"))


@query("rank_itineraries", f"""WITH {ITINS} SELECT od_id, signature, 1 AS rank, round(transit + walks * 1.25
      + greatest(CASE WHEN od_id % 3 = 0 THEN 0 ELSE od_id % 13 - access END, 0)
      + coalesce(list_sum(list_transform(waits[2:], lambda w: coalesce(w, 3))), 0), 4) AS total FROM v_itin""")
def rank_itineraries(spark, sf_dir):
    d = itins(spark, sf_dir)
    waits = d.select("od_id", "signature", F.when(F.col("od_id") % 3 != 0, F.col("od_id") % 13).alias("first_wait"),
                     F.col("live").alias("transfer_waits"))
    return I.rank_itineraries(d.drop("live"), waits, walk_factor=1.25).select("od_id", "signature", "rank", F.round("total", 4).alias("total"))


@query("distinct_itineraries", f"""WITH {ITINS}, a AS (SELECT od_id % 100 AS od_id, transfers, transit + walks AS total, regexp_replace(signature, ':.*$', '') AS signature FROM v_itin)
    SELECT od_id, signature, round(min(total), 3) AS total FROM a GROUP BY ALL""")
def distinct_itineraries(spark, sf_dir):
    d = itins(spark, sf_dir).withColumn("total", F.col("transit_minutes") + F.col("walk_minutes")).withColumn(
        "od_id", F.col("od_id") % 100).withColumn("signature", F.regexp_replace("signature", ":.*$", ""))
    return I.distinct_itineraries(d).select("od_id", "signature", F.round("total", 3).alias("total"))


@query("filter_mode", f"WITH {ITINS} SELECT od_id FROM v_itin WHERE NOT rail")
def filter_mode(spark, sf_dir):
    return I.filter_mode(itins(spark, sf_dir), "Bus").select("od_id")


@query("scale_walks", f"WITH {ITINS} SELECT od_id, round(coalesce((SELECT sum(round(minutes / 0.9, 1)) FROM v_kind k WHERE k.od_id = v_itin.od_id AND walk), 0), 1) AS walk_minutes FROM v_itin")
def scale_walks(spark, sf_dir):
    return I.scale_walks(itins(spark, sf_dir), 0.9).select("od_id", "walk_minutes")


@query("lines_used", f"""WITH {ITINS}, f AS (SELECT od_id, CASE WHEN mode = 'bus' THEN 'bus:' || route_id ELSE route_id END AS k, min(leg_no) AS n FROM v_kind WHERE NOT walk GROUP BY 1, 2)
    SELECT od_id, string_agg(k, ',' ORDER BY n) AS lines FROM f GROUP BY 1""")
def lines_used(spark, sf_dir):
    return array_text(I.lines_used(I.leg_rows(itins(spark, sf_dir))), "lines").drop("itin_id")


@query("merge_itineraries", f"""WITH {ITINS}, u AS (SELECT od_id // 10 AS od_id, signature, transit + walks AS total FROM v_itin),
    r AS (SELECT *, row_number() OVER (PARTITION BY od_id ORDER BY total, signature) AS rank FROM u) SELECT od_id, signature, round(total, 3) AS total, rank FROM r WHERE rank <= 5""")
def merge_itineraries(spark, sf_dir):
    d = itins(spark, sf_dir).withColumn("total", F.col("transit_minutes") + F.col("walk_minutes"))
    even, odd = d.where(F.col("od_id") % 2 == 0), d.where(F.col("od_id") % 2 == 1)
    fold = lambda x: x.withColumn("od_id", F.floor(F.col("od_id") / 10))
    return I.merge_itineraries(fold(even), fold(odd)).select("od_id", "signature", F.round("total", 3).alias("total"), F.col("rank").cast("bigint").alias("rank"))


POINTS = """v_pts AS (SELECT od_id, leg_no, CASE WHEN p % 5 = 0 THEN 'walk' ELSE 'transit' END AS leg_type, CASE WHEN p % 3 = 0 THEN 'rail' ELSE 'bus' END AS mode,
     41.64 + (p * 7919 % 3800) / 10000.0 AS to_lat, -87.94 + (p * 2741 % 4200) / 10000.0 AS to_lon,
     41.64 + (p * 7919 % 3800) / 10000.0 + (p % 3) * 0.0004 AS f_lat, -87.94 + (p * 2741 % 4200) / 10000.0 AS f_lon FROM v_legs),
   v_next AS (SELECT *, lead(leg_type) OVER w AS b_type, lead(mode) OVER w AS b_mode, lead(leg_no) OVER w AS b_no FROM v_pts WINDOW w AS (PARTITION BY od_id ORDER BY leg_no))"""


@query("transfer_points", f"""WITH {ITINS}, {POINTS} SELECT od_id, CASE WHEN leg_type = 'walk' THEN 'walk-transit' WHEN b_type = 'walk' THEN 'transit-walk'
      WHEN mode = 'rail' AND b_mode = 'rail' THEN 'rail-rail' WHEN mode = 'bus' AND b_mode = 'bus' THEN 'bus-bus' ELSE 'rail-bus' END AS kind, count(*) AS n
    FROM v_next WHERE b_type IS NOT NULL AND NOT (leg_type = 'walk' AND b_type = 'walk') GROUP BY ALL""")
def transfer_points(spark, sf_dir):
    li = S.call_lines(spark, sf_dir).select(F.col("l_orderkey").alias("od_id"), F.col("ln").alias("leg_no"), "p")
    p = F.col("p")
    legs = li.select("od_id", F.lit(1).alias("itin_id"), "leg_no", F.when(p % 5 == 0, "walk").otherwise("transit").alias("leg_type"),
                     F.when(p % 3 == 0, "rail").otherwise("bus").alias("mode"), S.lat_of(p).alias("to_lat"), S.lon_of(p, 2741).alias("to_lon"),
                     (S.lat_of(p) + p % 3 * 0.0004).alias("from_lat"), S.lon_of(p, 2741).alias("from_lon"))
    return I.transfer_points(legs).groupBy("od_id", "kind").agg(F.count("*").alias("n"))


@query("suffix_nearest", """WITH s AS (SELECT l_orderkey AS seq_id, l_linenumber AS pos, min(l_extendedprice) AS miles FROM lineitem GROUP BY ALL)
    SELECT a.seq_id, a.pos, CAST(arg_min(b.pos, struct_pack(m := b.miles, p := -b.pos)) AS INTEGER) AS best_pos, min(b.miles) AS best_miles FROM s a JOIN s b ON a.seq_id = b.seq_id AND b.pos >= a.pos GROUP BY ALL""")
def suffix_nearest(spark, sf_dir):
    s = S.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("seq_id"), F.col("l_linenumber").alias("pos")).agg(F.min("l_extendedprice").alias("miles"))
    return I.suffix_nearest(s).drop("miles")


@query("dedupe_by_line", """WITH c AS (SELECT DISTINCT s_suppkey AS od_id, i AS walk_minutes, (s_suppkey * 7 + i * 3) % 29 AS stop FROM supplier CROSS JOIN (SELECT unnest(range(3)) AS i)),
    n AS (SELECT DISTINCT p_partkey % 29 AS stop, p_partkey % 7 AS line FROM part WHERE (p_partkey * 31) % 11 = 0 AND p_partkey % 29 < 25),
    l AS (SELECT stop, list(line) AS lines FROM n GROUP BY 1),
    w AS (SELECT c.od_id, max(lines) FILTER (walk_minutes = 0) AS a, max(lines) FILTER (walk_minutes = 1) AS b, max(lines) FILTER (walk_minutes = 2) AS d,
       max(c.stop) FILTER (walk_minutes = 0) AS sa, max(c.stop) FILTER (walk_minutes = 1) AS sb, max(c.stop) FILTER (walk_minutes = 2) AS sd FROM c LEFT JOIN l ON c.stop = l.stop GROUP BY 1),
    k AS (SELECT *, b IS NULL OR NOT list_has_all(coalesce(a, []), b) AS kb FROM w)
    SELECT od_id, CAST(sa AS VARCHAR) AS stop_id FROM k UNION ALL SELECT od_id, CAST(sb AS VARCHAR) FROM k WHERE kb
    UNION ALL SELECT od_id, CAST(sd AS VARCHAR) FROM k WHERE d IS NULL OR NOT list_has_all(list_concat(coalesce(a, []), CASE WHEN kb THEN coalesce(b, []) ELSE [] END), d)""")
def dedupe_by_line(spark, sf_dir):
    k = F.col("s_suppkey")
    c = S.table(spark, sf_dir, "supplier").select(k.alias("od_id"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("walk_minutes"))
    c = c.withColumn("stop_id", ((F.col("od_id") * 7 + F.col("walk_minutes") * 3) % 29).cast("string"))
    p = F.col("p_partkey")
    lines = S.table(spark, sf_dir, "part").where((p * 31 % 11 == 0) & (p % 29 < 25)).select((p % 29).cast("string").alias("stop_id"), (p % 7).cast("string").alias("line"))
    return I.dedupe_by_line(c, lines).select("od_id", "stop_id")


@query("legs_from_path", f"""WITH RECURSIVE l AS (SELECT l_orderkey AS path_id, ln, p FROM {LINES}),
    e AS (SELECT path_id, row_number() OVER (PARTITION BY path_id ORDER BY ln) AS n, p, p % 6 = 0 AS walk, 'L' || (p % 4) AS route,
       CASE WHEN p % 3 = 0 THEN ['L' || (p % 4), 'L' || ((p + 1) % 4), 'L' || ((p + 2) % 4)] ELSE ['L' || (p % 4)] END AS served, p % 9 + 1.0 AS m FROM l),
    r(path_id, n, legs, riding, cur) AS (
      SELECT path_id, 0, 0, false, NULL::VARCHAR FROM (SELECT DISTINCT path_id FROM e)
      UNION ALL SELECT r.path_id, e.n,
        CASE WHEN e.walk THEN legs + 1 WHEN riding AND list_contains(served, cur) THEN legs WHEN riding THEN legs + 2 ELSE legs + 1 END, NOT e.walk,
        CASE WHEN e.walk THEN cur WHEN cur IS NOT NULL AND list_contains(served, cur) THEN cur ELSE e.route END
      FROM r JOIN e ON e.path_id = r.path_id AND e.n = r.n + 1)
    SELECT path_id, CAST(arg_max(legs, n) AS BIGINT) AS legs, arg_max(cur, n) AS last_line, CAST((SELECT sum(m) FROM e WHERE e.path_id = r.path_id) AS DOUBLE) AS minutes FROM r GROUP BY path_id""")
def legs_from_path(spark, sf_dir):
    """Legs, last line and edge minutes of one path per order."""
    p = F.col("p")
    li = S.call_lines(spark, sf_dir).select(F.col("l_orderkey").alias("path_id"), F.col("ln").alias("edge_no"), "p")
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("path_id").orderBy("edge_no"))
    code = lambda i: F.concat(F.lit("L"), (p + i) % 4)
    entry = lambda i: F.struct(code(i).alias("route_id"), F.lit("0").alias("direction_id"), code(i).alias("line"))
    walk = p % 6 == 0
    edges = li.withColumn("n", n).select(
        "path_id", "edge_no", F.col("n").cast("string").alias("from_id"), (F.col("n") + 1).cast("string").alias("to_id"),
        F.when(walk, "walk").otherwise("transit").alias("edge_type"), F.lit("rail").alias("mode"), code(0).alias("route_id"), code(0).alias("line"),
        (p % 9 + 1).cast("double").alias("minutes"), F.when(p % 3 == 0, F.array(entry(0), entry(1), entry(2))).alias("all_routes"))
    legs = I.legs_from_path(edges)
    platform = (F.col("leg_type") == "walk") & (F.col("from_id") == F.col("to_id"))
    return legs.groupBy("path_id").agg(
        F.count("*").alias("legs"), F.max_by(F.col("route_id"), F.when(F.col("leg_type") == "transit", F.col("leg_no"))).alias("last_line"),
        F.sum(F.when(platform, 0.0).otherwise(F.col("minutes"))).alias("minutes"))


@query("clip_shape", """WITH pts AS (SELECT c_custkey % 3 AS shape_id, c_custkey // 3 AS seq, 41.64 + (c_custkey * 7919 % 3800) / 10000.0 AS lat,
      -87.94 + (c_custkey * 2741 % 4200) / 10000.0 AS lon FROM customer),
    p AS (SELECT *, row_number() OVER (PARTITION BY shape_id ORDER BY seq) - 1 AS pos FROM pts),
    l AS (SELECT s_suppkey AS leg_id, s_suppkey % 4 AS shape_id, 41.64 + (s_suppkey * 31 % 3800) / 10000.0 AS flat, -87.94 + (s_suppkey * 57 % 4200) / 10000.0 AS flon,
      41.64 + (s_suppkey * 131 % 3800) / 10000.0 AS tlat, -87.94 + (s_suppkey * 157 % 4200) / 10000.0 AS tlon FROM supplier),
    e AS (SELECT leg_id, l.shape_id, arg_min(pos, struct_pack(d := pow(lat - flat, 2) + pow(lon - flon, 2), p := pos)) AS a,
      arg_min(pos, struct_pack(d := pow(lat - tlat, 2) + pow(lon - tlon, 2), p := pos)) AS b FROM l JOIN p USING (shape_id) GROUP BY ALL),
    s AS (SELECT *, abs(a - b) + 1 AS n FROM e WHERE a <> b),
    i AS (SELECT s.*, i AS point_no, CASE WHEN n <= 100 THEN i WHEN i = 99 THEN n - 1 ELSE CAST(round_even(i * ((n - 1) / 99.0), 0) AS BIGINT) END AS k FROM s CROSS JOIN (SELECT unnest(range(100)) AS i) WHERE i < n)
    SELECT leg_id, CAST(point_no AS INTEGER) AS point_no, round(lat, 5) AS lat, round(lon, 5) AS lon FROM i JOIN p ON p.shape_id = i.shape_id AND p.pos = CASE WHEN a < b THEN a + k ELSE a - k END
    UNION ALL SELECT leg_id, 0, round(flat, 5), round(flon, 5) FROM l WHERE leg_id NOT IN (SELECT leg_id FROM s)
    UNION ALL SELECT leg_id, 1, round(tlat, 5), round(tlon, 5) FROM l WHERE leg_id NOT IN (SELECT leg_id FROM s)""")
def clip_shape(spark, sf_dir):
    c, k = S.table(spark, sf_dir, "customer"), F.col("c_custkey")
    shapes = c.select((k % 3).alias("shape_id"), F.floor(k / 3).alias("seq"), S.lat_of(k).alias("lat"), S.lon_of(k, 2741).alias("lon"))
    n = F.col("s_suppkey")
    at = lambda a, b: (F.lit(41.64) + n * a % 3800 / F.lit(10000.0), F.lit(-87.94) + n * b % 4200 / F.lit(10000.0))
    (fa, fo), (ta, to) = at(31, 57), at(131, 157)
    legs = S.table(spark, sf_dir, "supplier").select(
        n.alias("leg_id"), (n % 4).alias("route_key"), F.lit("0").alias("direction_id"), fa.alias("from_lat"), fo.alias("from_lon"),
        ta.alias("to_lat"), to.alias("to_lon"))
    chosen = shapes.select(F.col("shape_id").alias("route_key"), F.lit("0").alias("direction_id"), "shape_id").distinct()
    return I.clip_shape(legs, shapes, chosen)
