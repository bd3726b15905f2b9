"""Registered queries: live feeds, alerts, weather, crowding."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import weather as W
from ..operators import live as V
from ..sources import adapters as S
from ..sources import feeds as D
from .analytics_queries import array_text
from .feed import Feed
from .registry import query
from .views import LINES, with_views

ARRIVALS = """v_eta AS (SELECT o_orderkey AS k, o_custkey, 0 AS part, o_orderkey * 37 % 3600 - 300 AS s FROM orders WHERE o_orderkey % 50 <> 0
     UNION ALL SELECT o_orderkey, o_custkey, 1, o_orderkey * 37 % 3600 + 270 FROM orders WHERE o_orderkey % 50 <> 0 AND o_orderkey % 2 = 1 AND o_orderkey % 7 <> 0),
   v_train AS (SELECT 'train' AS mode, CAST(40000 + k % 50 AS VARCHAR) AS stop_id, list_extract(['Red','Brn','G','Zz'], o_custkey % 4 + 1) AS line_code,
     list_extract(['Red Line','Brown Line','Green Line','Zz'], o_custkey % 4 + 1) AS line, list_extract(['Howard','95th','Loop','Kimball'], k % 4 + 1) AS destination,
     CAST(greatest(0, round_even(s / 60.0, 0)) AS INTEGER) AS minutes, k % 3 = 0 AS is_approaching, k % 5 = 0 AS is_delayed FROM v_eta),
   v_bus AS (SELECT 'bus' AS mode, CAST(o_custkey % 40 AS VARCHAR) AS line_code, CAST(o_orderkey % 200 AS VARCHAR) AS stop_id,
     list_extract(['northbound','eastbound'], o_orderkey % 2 + 1) AS direction, list_extract(['Lake','Park','Pier'], o_orderkey % 3 + 1) AS destination,
     CAST(CASE WHEN o_orderkey % 6 = 0 THEN 0 ELSE o_orderkey * 7 % 40 END AS INTEGER) AS minutes, o_orderkey % 4 <> 2 AS is_delayed,
     list_extract(['EMPTY','HALF_EMPTY','FULL',''], o_orderkey % 4 + 1) AS load, o_orderkey AS payload_id FROM orders)"""


def trains(spark, sf_dir):
    return D.parse_train_arrivals(S.train_payloads(spark, sf_dir))


def buses(spark, sf_dir):
    return D.parse_bus_predictions(S.bus_payloads(spark, sf_dir))


@query("parse_train_arrivals", f"WITH {ARRIVALS} SELECT stop_id, line, line_code, destination, minutes, is_approaching, is_delayed, count(*) AS n FROM v_train GROUP BY ALL")
def parse_train_arrivals(spark, sf_dir):
    cols = ["stop_id", "line", "line_code", "destination", "minutes", "is_approaching", "is_delayed"]
    return trains(spark, sf_dir).groupBy(*cols).agg(F.count("*").alias("n"))


@query("train_errors", "SELECT CAST(40000 + o_orderkey % 50 AS VARCHAR) AS station_id, '101' AS code, 'limit' AS message, count(*) AS n FROM orders WHERE o_orderkey % 50 = 0 GROUP BY 1")
def train_errors(spark, sf_dir):
    return D.train_errors(S.train_payloads(spark, sf_dir)).groupBy("station_id", "code", "message").agg(F.count("*").alias("n"))


@query("parse_bus_predictions", f"WITH {ARRIVALS} SELECT payload_id, line_code, direction, stop_id, destination, minutes, is_delayed, load FROM v_bus")
def parse_bus_predictions(spark, sf_dir):
    return buses(spark, sf_dir).select("payload_id", "line_code", "direction", "stop_id", "destination", "minutes", "is_delayed", "load")


@query("filter_load", f"WITH {ARRIVALS} SELECT payload_id, load FROM v_bus WHERE load = 'HALF_EMPTY'")
def filter_load(spark, sf_dir):
    return V.filter_load(buses(spark, sf_dir), "Half-Full").select("payload_id", "load")


ALERTS = """v_alerts AS (SELECT o_orderkey AS seq, CAST(o_orderkey % 500 AS VARCHAR) AS alert_id, 'Notice ' || (o_orderkey % 500) AS headline,
     CAST(o_orderkey * 13 % 100 AS INTEGER) AS severity, CASE WHEN o_orderkey % 3 <> 0 THEN '2024-02-01' END AS event_end,
     list_extract(['red','brn','22','X9'], o_orderkey % 4 + 1) AS route, o_orderkey % 2 = 1 AS two FROM orders)"""


@query("parse_alerts_json", f"WITH {ALERTS} SELECT seq, alert_id, headline, severity, severity >= 70 AS is_major, event_end, route || CASE WHEN two THEN ',7' ELSE '' END AS affected_routes FROM v_alerts")
def parse_alerts_json(spark, sf_dir):
    a = D.parse_alerts_json(S.alert_payloads(spark, sf_dir).drop("xml"))
    return array_text(a.drop("impact"), "affected_routes")


@query("parse_alerts_xml", f"""WITH {ALERTS} SELECT seq, alert_id, headline, severity, CASE WHEN severity >= 70 THEN 'Major' WHEN severity >= 40 THEN 'Minor' ELSE 'Planned' END AS severity_class,
    list_extract(['Red','Brown','22','X9'], seq % 4 + 1) || ',7' AS routes FROM v_alerts""")
def parse_alerts_xml(spark, sf_dir):
    a = D.parse_alerts_xml(S.alert_payloads(spark, sf_dir).drop("body"), "xml")
    return array_text(a.drop("short_description"), "routes")


@query("dedupe_alerts", f"WITH {ALERTS} SELECT alert_id, arg_min(severity, seq) AS severity, arg_min(event_end IS NULL, seq) AS open_ended FROM v_alerts GROUP BY 1")
def dedupe_alerts(spark, sf_dir):
    a = D.parse_alerts_json(S.alert_payloads(spark, sf_dir).drop("xml"))
    return V.dedupe_alerts(a).select("alert_id", "severity", F.col("event_end").isNull().alias("open_ended"))


@query("significant_alerts", f"WITH {ALERTS} SELECT seq, severity FROM v_alerts WHERE severity >= 40")
def significant_alerts(spark, sf_dir):
    return V.significant_alerts(D.parse_alerts_json(S.alert_payloads(spark, sf_dir).drop("xml"))).select("seq", "severity")


@query("alerts_selected", f"WITH {ALERTS} SELECT seq FROM v_alerts WHERE seq % 4 IN (0, 3)")
def alerts_selected(spark, sf_dir):
    a = D.parse_alerts_xml(S.alert_payloads(spark, sf_dir).drop("body"), "xml")
    return V.alerts_selected(a, ["Red"], ["X9"]).select("seq")


@query("alerts_for", f"""WITH {ALERTS}, n AS (SELECT DISTINCT alert_id, route FROM v_alerts UNION SELECT alert_id, '7' FROM v_alerts WHERE two),
    l AS (SELECT DISTINCT l_orderkey AS od_id, l_suppkey % 2 AS itin_id, list_extract(['red','brn','zz','7'], l_partkey % 4 + 1) AS route FROM lineitem WHERE l_linenumber > 1)
    SELECT od_id, itin_id, count(*) AS alerts, sha256(string_agg(alert_id, ',' ORDER BY alert_id)) AS alert_ids
    FROM (SELECT DISTINCT od_id, itin_id, alert_id FROM l JOIN n USING (route)) GROUP BY ALL""")
def alerts_for(spark, sf_dir):
    li = S.table(spark, sf_dir, "lineitem")
    legs = li.select(F.col("l_orderkey").alias("od_id"), (F.col("l_suppkey") % 2).alias("itin_id"),
                     F.when(F.col("l_linenumber") > 1, "transit").otherwise("walk").alias("leg_type"),
                     S.pick(["Red", "Brn", "zz", "7"], F.col("l_partkey") % 4).alias("line_code"))
    a = D.parse_alerts_json(S.alert_payloads(spark, sf_dir).drop("xml"))
    return V.alerts_for(legs, a, lists=True).select(
        "od_id", "itin_id", "alerts", F.sha2(F.array_join("alert_ids", ","), 256).alias("alert_ids"))


@query("parse_route_status", """SELECT c_custkey AS payload_id, CAST(c_custkey % 40 AS VARCHAR) AS service_id, CASE WHEN c_custkey % 5 = 0 THEN 'Significant Delays' ELSE 'Normal Service' END AS status FROM customer""")
def parse_route_status(spark, sf_dir):
    p = S.service_payloads(spark, sf_dir).select("payload_id", "status")
    return D.parse_route_status(p, "status").select("payload_id", "service_id", "status")


@query("disrupted", "SELECT c_custkey AS payload_id FROM customer WHERE c_custkey % 5 = 0")
def disrupted(spark, sf_dir):
    p = S.service_payloads(spark, sf_dir).select("payload_id", "status")
    return V.disrupted(D.parse_route_status(p, "status")).select("payload_id")


@query("active_lines", """SELECT list_extract(['Red','G','P'], c_custkey % 3 + 1) AS line_code, CAST(sum(c_custkey % 4) AS BIGINT) AS active_trains FROM customer WHERE c_custkey % 4 > 0 GROUP BY 1""")
def active_lines(spark, sf_dir):
    p = S.service_payloads(spark, sf_dir).select("payload_id", "positions")
    return V.active_lines(D.parse_vehicle_positions(p, "positions")).drop("line")


@query("active_buses", with_views(["v_routes"], """SELECT DISTINCT CAST(c_custkey % 60 AS VARCHAR) AS route, coalesce(long_name, 'Feed ' || (c_custkey % 60)) AS name, '#' || coalesce(color, 'aabbcc') AS color
    FROM customer LEFT JOIN v_routes ON short_name = CAST(c_custkey % 60 AS VARCHAR)"""))
def active_buses(spark, sf_dir):
    p = S.service_payloads(spark, sf_dir).select("payload_id", "buses")
    return V.active_buses(D.parse_bus_routes(p, "buses"), Feed.from_tables(spark, sf_dir).routes)


WALKS = "v_walks AS (SELECT s_suppkey AS walk_id, CAST(40000 + s_suppkey * 3 % 50 AS VARCHAR) AS stop_id, CAST(s_suppkey % 20 AS DOUBLE) AS walk_minutes FROM supplier)"


def walks(spark, sf_dir):
    k = F.col("s_suppkey")
    return S.table(spark, sf_dir, "supplier").select(
        k.alias("walk_id"), (F.lit(40000) + k * 3 % 50).cast("string").alias("stop_id"), (k % 20).cast("double").alias("walk_minutes"))


@query("catchable", f"""WITH {ARRIVALS}, {WALKS} SELECT walk_id, line_code, stop_id, destination, min(minutes) AS minutes
    FROM v_train JOIN v_walks USING (stop_id) WHERE minutes >= walk_minutes GROUP BY ALL""")
def catchable(spark, sf_dir):
    return V.catchable(trains(spark, sf_dir), walks(spark, sf_dir))


@query("earliest", f"WITH {ARRIVALS} SELECT line_code, stop_id, min(minutes) AS minutes FROM v_bus GROUP BY ALL")
def earliest(spark, sf_dir):
    return V.earliest(buses(spark, sf_dir))


@query("stop_board", f"""WITH {ARRIVALS}, a AS (SELECT mode, stop_id, line_code, destination, minutes FROM v_train UNION ALL SELECT mode, stop_id, line_code, destination, minutes FROM v_bus),
    r AS (SELECT *, row_number() OVER (PARTITION BY mode, stop_id ORDER BY minutes, line_code, destination) AS n FROM a),
    p AS (SELECT DISTINCT 'train' AS mode, CAST(40000 + s_suppkey % 70 AS VARCHAR) AS stop_id FROM supplier UNION SELECT 'bus', CAST(s_suppkey * 3 AS VARCHAR) FROM supplier)
    SELECT p.mode || ':' || p.stop_id AS "key", coalesce(string_agg(line_code || '/' || destination || '/' || minutes, ',' ORDER BY n), '') AS arrivals
    FROM p LEFT JOIN r ON r.mode = p.mode AND r.stop_id = p.stop_id AND n <= 3 GROUP BY 1""")
def stop_board(spark, sf_dir):
    cols = ["mode", "stop_id", "line_code", "destination", "minutes"]
    a = trains(spark, sf_dir).select(*cols).unionByName(buses(spark, sf_dir).select(*cols))
    k, s = F.col("s_suppkey"), S.table(spark, sf_dir, "supplier")
    pins = s.select(F.lit("train").alias("mode"), (F.lit(40000) + k % 70).cast("string").alias("stop_id")).unionByName(
        s.select(F.lit("bus").alias("mode"), (k * 3).cast("string").alias("stop_id")))
    b = V.stop_board(a, pins)
    line = F.transform("arrivals", lambda x: F.concat_ws("/", x["route"], x["destination"], x["minutes"]))
    return b.select("key", F.array_join(line, ",").alias("arrivals"))


TERMINALS = """v_names AS (SELECT DISTINCT lower(CASE c_custkey % 3 WHEN 0 THEN p_name WHEN 1 THEN p_name || ' & ' || p_brand ELSE p_name || ' & ' || p_brand || ' loop' END) AS n
     FROM customer JOIN part ON p_partkey = c_custkey * 7 % 1900),
   v_st AS (SELECT lower(name) AS s, min(struct_pack(i := CAST(stop_id AS VARCHAR), lat := lat)) AS p FROM v_stops WHERE kind = 'station' GROUP BY 1),
   v_known AS (SELECT n, p FROM v_names JOIN v_st ON n = s),
   v_near AS (SELECT n, s, p, abs(length(s) - length(n)) AS gap FROM v_names JOIN v_st ON contains(n, s) OR contains(s, n) WHERE n NOT IN (SELECT n FROM v_known)),
   v_scored AS (SELECT *, 1.0 - levenshtein(n, s) * 1.0 / greatest(length(n), length(s)) AS r FROM v_near QUALIFY gap = min(gap) OVER (PARTITION BY n))"""


@query("resolve_terminal", with_views(["v_stops"], """
    SELECT n AS terminal, p.i AS stop_id FROM v_known UNION ALL
    SELECT n, arg_min(p.i, struct_pack(r := -r, p := p)) FROM v_scored GROUP BY n""", TERMINALS))
def resolve_terminal(spark, sf_dir):
    c, p = S.table(spark, sf_dir, "customer"), S.table(spark, sf_dir, "part")
    full = F.concat(F.col("p_name"), F.lit(" & "), F.col("p_brand"))
    k = F.col("c_custkey")
    names = c.join(p, F.col("p_partkey") == k * 7 % 1900).select(
        F.when(k % 3 == 0, F.col("p_name")).when(k % 3 == 1, full).otherwise(F.concat(full, F.lit(" loop"))).alias("destination"))
    st = Feed.from_tables(spark, sf_dir).stops.where(F.col("kind") == "station")
    return V.resolve_terminal(names, st, exact_ratio=False).select("terminal", "stop_id")


PLACE = "41.64 + ({0} * 7919 % 3800) / 10000.0 AS lat, -87.94 + ({0} * 2741 % 4200) / 10000.0 AS lon"
PICK = f"""{ARRIVALS}, {WALKS},
   v_c AS (SELECT walk_id, line_code, stop_id, destination, min(minutes) AS minutes FROM v_train JOIN v_walks USING (stop_id) WHERE minutes >= walk_minutes GROUP BY ALL),
   v_place AS (SELECT CAST(40000 + i AS VARCHAR) AS stop_id, {PLACE.format('(i * 3 + 1)')} FROM (SELECT DISTINCT s_suppkey % 50 AS i FROM supplier)),
   v_term AS (SELECT destination, 41.64 + (i * 7919 % 3800) / 10000.0 AS lat, -87.94 + (i * 2741 % 4200) / 10000.0 AS lon FROM (VALUES ('Howard', 5), ('95th', 17), ('Loop', 29)) t(destination, i)),
   v_legs AS (SELECT l_orderkey * 100 + ln AS leg_id, l_suppkey AS walk_id FROM {LINES}),
   v_l AS (SELECT leg_id, walk_id, list_extract(['Red','Brn','G','Zz'], leg_id % 4 + 1) AS line_code, CAST(40000 + walk_id * 3 % 50 AS VARCHAR) AS from_id,
      CAST(40000 + (leg_id // 10) % 50 AS VARCHAR) AS to_id, CAST(40000 + (leg_id // 7) % 50 AS VARCHAR) AS final_id FROM v_legs),
   v_d AS (SELECT l.*, a.lat AS alat, a.lon AS alon, CASE WHEN sqrt(pow(b.lat - a.lat, 2) + pow(b.lon - a.lon, 2)) < 0.005 AND l.final_id <> l.to_id
        AND sqrt(pow(f.lat - a.lat, 2) + pow(f.lon - a.lon, 2)) > sqrt(pow(b.lat - a.lat, 2) + pow(b.lon - a.lon, 2)) THEN struct_pack(y := f.lat - a.lat, x := f.lon - a.lon)
        ELSE struct_pack(y := b.lat - a.lat, x := b.lon - a.lon) END AS dir
      FROM v_l l LEFT JOIN v_place a ON a.stop_id = from_id LEFT JOIN v_place b ON b.stop_id = to_id LEFT JOIN v_place f ON f.stop_id = final_id),
   v_h AS (SELECT d.leg_id, c.minutes, (dir.y * (t.lat - alat) + dir.x * (t.lon - alon)) / nullif(sqrt(pow(dir.y, 2) + pow(dir.x, 2)) * sqrt(pow(t.lat - alat, 2) + pow(t.lon - alon, 2)), 0) AS cs
      FROM v_d d JOIN v_c c ON c.walk_id = d.walk_id AND c.line_code = d.line_code AND c.stop_id = d.from_id LEFT JOIN v_term t ON t.destination = c.destination),
   v_p AS (SELECT leg_id, minutes, CASE WHEN cs > 0 THEN cs END AS cs FROM v_h),
   v_r AS (SELECT *, row_number() OVER (PARTITION BY leg_id ORDER BY cs DESC NULLS LAST, minutes) AS r FROM v_p)"""


@query("pick_wait", f"""WITH {PICK} SELECT leg_id, CASE WHEN count(*) > 1 AND max(cs) FILTER (r = 1) IS NOT NULL AND
      (max(cs) FILTER (r = 2) IS NULL OR max(cs) FILTER (r = 1) - max(cs) FILTER (r = 2) >= 0.15) THEN max(minutes) FILTER (r = 1) ELSE min(minutes) END AS wait FROM v_r GROUP BY leg_id""")
def pick_wait(spark, sf_dir):
    li = S.call_lines(spark, sf_dir).withColumnRenamed("l_suppkey", "walk_id")
    leg = F.col("l_orderkey") * 100 + F.col("ln")
    sid = lambda i: (F.lit(40000) + i % 50).cast("bigint").cast("string")
    legs = li.select(leg.alias("leg_id"), "walk_id", S.pick(["Red", "Brn", "G", "Zz"], leg % 4).alias("line_code"),
                     sid(F.col("walk_id") * 3).alias("from_id"), sid(F.floor(leg / 10)).alias("to_id"), sid(F.floor(leg / 7)).alias("final_id"))
    i = (F.col("s_suppkey") % 50).alias("i")
    places = S.table(spark, sf_dir, "supplier").select(i).distinct().select(
        (F.lit(40000) + F.col("i")).cast("string").alias("stop_id"), S.lat_of(F.col("i") * 3 + 1).alias("lat"), S.lon_of(F.col("i") * 3 + 1, 2741).alias("lon"))
    terms = spark.sql("SELECT * FROM VALUES ('howard', 5), ('95th', 17), ('loop', 29) AS t(terminal, i)").select(
        "terminal", S.lat_of(F.col("i")).alias("lat"), S.lon_of(F.col("i"), 2741).alias("lon"))
    return V.pick_wait(legs, V.catchable(trains(spark, sf_dir), walks(spark, sf_dir)), places, terms)


@query("transfer_boardings", f"""WITH l AS {LINES},
    t AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY ln) AS n FROM l WHERE p % 5 <> 0)
    SELECT DISTINCT CASE WHEN p % 3 = 0 THEN 'rail' ELSE 'bus' END AS mode, CASE WHEN p % 3 = 0 THEN 'Red' ELSE CAST(p % 40 AS VARCHAR) END AS line_code, CAST(p AS VARCHAR) AS stop_id FROM t WHERE n > 1""")
def transfer_boardings(spark, sf_dir):
    p = F.col("p")
    li = S.call_lines(spark, sf_dir)
    legs = li.select(F.col("l_orderkey").alias("od_id"), F.lit(1).alias("itin_id"), F.col("ln").alias("leg_no"),
                     F.when(p % 5 == 0, "walk").otherwise("transit").alias("leg_type"), F.when(p % 3 == 0, "rail").otherwise("bus").alias("mode"),
                     F.when(p % 3 == 0, "Red").otherwise((p % 40).cast("string")).alias("line_code"), p.cast("string").alias("from_id"))
    return V.transfer_boardings(legs)


@query("weather_asof", """WITH e AS (SELECT *, round(41.8 + user_id % 3 * 0.01 + 0.001, 2) AS c, event_type IN ('click','purchase','view') AS req FROM events),
    r AS (SELECT event_id, ts, c FROM e WHERE req), f AS (SELECT event_id AS fid, ts AS fts, c AS fc FROM e WHERE NOT req)
    SELECT event_id AS request_id, CASE WHEN fts >= ts - INTERVAL 30 MINUTE THEN fid END AS forecast_id FROM r ASOF LEFT JOIN f ON r.c = f.fc AND r.ts >= f.fts""")
def weather_asof(spark, sf_dir):
    req, fc = S.asof_inputs(spark, sf_dir)
    return V.weather_asof(req, fc).select("request_id", F.col("forecast.forecast_id").alias("forecast_id"))


PERIODS_SQL = """v_p AS (SELECT c_custkey AS payload_id, i AS place, (c_custkey + i) % 24 AS hour,
     CASE WHEN c_custkey % 4 = 0 THEN ((c_custkey * 7 + i * 5) % 130 - 20) * 9.0 / 5 + 32 ELSE (c_custkey * 7 + i * 5) % 130 - 20.0 END AS t,
     list_extract(['none','rain','snow','freezing_rain','sleet','snow','rain','snow'], (c_custkey + i) % 8 + 1) AS precipitation,
     list_extract(['','light','heavy','light','moderate','light','moderate','heavy'], (c_custkey + i) % 8 + 1) AS intensity,
     CASE WHEN i % 2 = 0 THEN (c_custkey + i) % 30 ELSE (5 + (c_custkey + i) % 30 + 5) / 2.0 END AS w,
     CASE WHEN i % 3 <> 0 THEN CAST((c_custkey + i) % 60 AS DOUBLE) END AS gust,
     CASE WHEN i % 5 = 0 OR (c_custkey + i) % 100 = 0 THEN 50.0 ELSE (c_custkey + i) % 100 END AS h
     FROM customer CROSS JOIN (SELECT unnest(range(7)) AS i)),
   v_h AS (SELECT *, -42.379 + 2.04901523 * t + 10.14333127 * h - 0.22475541 * t * h - 6.83783e-3 * t * t - 5.481717e-2 * h * h
        + 1.22874e-3 * t * t * h + 8.5282e-4 * t * h * h - 1.99e-6 * t * t * h * h AS hi FROM v_p),
   v_f AS (SELECT payload_id, place, hour, CAST(t AS DOUBLE) AS temperature_f, precipitation, intensity, CAST(w AS DOUBLE) AS wind_mph, gust,
     CASE WHEN t <= 50 AND w >= 3 THEN 35.74 + 0.6215 * t - 35.75 * pow(w, 0.16) + 0.4275 * t * pow(w, 0.16)
      WHEN t >= 80 THEN greatest(t, CASE WHEN h < 13 AND t BETWEEN 80 AND 112 THEN hi - (13 - h) / 4 * sqrt((17 - abs(t - 95)) / 17)
        WHEN h > 85 AND t BETWEEN 80 AND 87 THEN hi + (h - 85) / 10 * (87 - t) / 5 ELSE hi END) ELSE t END AS feels FROM v_h)"""


@query("parse_forecast", f"WITH {PERIODS_SQL} SELECT payload_id, CAST(place AS INTEGER) AS place, CAST(hour AS INTEGER) AS hour, temperature_f, precipitation, intensity, wind_mph, gust AS gust_mph, round(feels, 1) AS feels_like_f FROM v_f")
def parse_forecast(spark, sf_dir):
    p = S.forecast_payloads(spark, sf_dir).select("payload_id", "body")
    return D.parse_forecast(p).drop("short_forecast")


@query("walk_factor", f"""WITH {PERIODS_SQL} SELECT payload_id, round(CAST(greatest(0.60, CASE precipitation WHEN 'freezing_rain' THEN 0.78 WHEN 'sleet' THEN 0.78
      WHEN 'rain' THEN CASE intensity WHEN 'heavy' THEN 0.82 WHEN 'moderate' THEN 0.90 ELSE 0.96 END
      WHEN 'snow' THEN CASE intensity WHEN 'heavy' THEN 0.74 WHEN 'moderate' THEN 0.84 ELSE 0.92 END ELSE 1.0 END
      * CASE WHEN gust > 35 THEN 0.90 ELSE 1.0 END * CASE WHEN round(feels, 1) < 0 THEN 0.88 ELSE 1.0 END) AS DOUBLE), 6) AS factor,
    conditions
    FROM (SELECT *, concat_ws(',', CASE WHEN round(feels, 1) < 0 THEN 'wind_chill' WHEN round(feels, 1) < 15 THEN 'extreme_cold' END,
      CASE WHEN precipitation <> 'none' AND intensity = 'heavy' THEN 'heavy_' || precipitation END,
      CASE WHEN gust > 35 THEN 'high_gusts' END) AS conditions FROM v_f WHERE place = 1)""")
def walk_factor(spark, sf_dir):
    p = D.parse_forecast(S.forecast_payloads(spark, sf_dir).select("payload_id", "body")).where(F.col("place") == 1)
    c = [F.col(x) for x in ("precipitation", "intensity", "gust_mph", "feels_like_f")]
    return p.select("payload_id", F.round(W.walk_factor(*c), 6).alias("factor"), F.array_join(W.active_conditions(*c), ",").alias("conditions"))


@query("forecast_alerts", """SELECT c_custkey AS payload_id, CASE c_custkey % 6 WHEN 0 THEN 'Warning 0' WHEN 1 THEN 'Warning 0,Event 1'
    ELSE 'Warning 0,Event 1,Warning 2' END AS headlines FROM customer""")
def forecast_alerts(spark, sf_dir):
    p = S.forecast_payloads(spark, sf_dir).select("payload_id", "alerts")
    return array_text(D.parse_forecast_alerts(p, "alerts"), "headlines")


@query("forecast_turn", f"""WITH {PERIODS_SQL}, a AS (SELECT payload_id, max(precipitation) FILTER (place = 0) AS p0, max(precipitation) FILTER (place = 2) AS p2, max(precipitation) FILTER (place = 3) AS p3 FROM v_p GROUP BY 1)
    SELECT payload_id, CASE WHEN p0 <> 'none' AND p2 = 'none' THEN '(forecast: clears in ~2h)' WHEN p0 = 'none' AND p2 <> 'none' THEN '(forecast: ' || p2 || ' starts in ~2h)'
      WHEN p0 <> 'none' AND p3 = 'none' THEN '(forecast: clears in ~3h)' WHEN p0 = 'none' AND p3 <> 'none' THEN '(forecast: ' || p3 || ' starts in ~3h)' ELSE '' END AS hint FROM a""")
def forecast_turn(spark, sf_dir):
    p = D.parse_forecast(S.forecast_payloads(spark, sf_dir).select("payload_id", "body"))
    a = p.groupBy("payload_id").agg(
        F.max(F.when(F.col("place") == 0, F.col("precipitation"))).alias("now"),
        F.array_sort(F.collect_list(F.when(F.col("place") > 0, F.struct("place", "precipitation"))))["precipitation"].alias("next"))
    return a.select("payload_id", V.forecast_turn(F.col("now"), F.col("next")).alias("hint"))


@query("crowding_by_itinerary", """WITH l AS (SELECT o_orderkey AS od_id, o_custkey % 2 AS itin_id, o_orderkey % 2 = 0 AS rail, CAST(o_orderkey % 6 = 0 AS INTEGER) AS hub, o_orderkey % 20 AS pos,
      list_extract(['Northbound','Southbound','Eastbound'], o_orderkey % 3 + 1) AS way, CAST(o_orderdate AS DATE) AS d, (o_orderkey * 7) % 1440 AS m,
      strftime(o_orderdate, '%m-%d') IN ('07-04', '12-25') AS hol FROM orders),
    p AS (SELECT *, CASE WHEN hol OR isodow(d) > 5 THEN CASE WHEN m BETWEEN 540 AND 1259 THEN 'regular' ELSE 'off_peak' END
        WHEN m BETWEEN 390 AND 569 OR m BETWEEN 930 AND 1109 THEN 'peak' WHEN m BETWEEN 570 AND 929 OR m BETWEEN 1110 AND 1259 THEN 'regular' ELSE 'off_peak' END AS period FROM l),
    s AS (SELECT od_id, itin_id, least(1.0, CASE period WHEN 'peak' THEN 0.75 WHEN 'regular' THEN 0.45 ELSE 0.2 END
        * CASE WHEN period <> 'peak' THEN 1.0 WHEN (rail OR way IN ('Southbound','Eastbound')) = (m < 720) THEN 1.2 ELSE 0.8 END
        * (0.6 + 0.4 * sin(pos / 20.0 * pi())) * CASE WHEN rail AND hub = 1 THEN 1.35 ELSE 1.0 END) AS score FROM p)
    SELECT od_id, itin_id, CASE WHEN score >= 0.8 THEN 'very_high' WHEN score >= 0.55 THEN 'high' WHEN score >= 0.3 THEN 'moderate' ELSE 'low' END AS level,
      CASE WHEN score >= 0.8 THEN 'very crowded' WHEN score >= 0.55 THEN 'busy' WHEN score >= 0.3 THEN 'moderate' ELSE 'light' END AS label, round(score, 3) AS score FROM s""")
def crowding_by_itinerary(spark, sf_dir):
    o, k = S.table(spark, sf_dir, "orders"), F.col("o_orderkey")
    local = F.col("o_orderdate").cast("date").cast("timestamp_ntz") + F.make_interval(mins=(k * 7 % 1440).cast("int"))
    legs = o.select(
        k.alias("od_id"), (F.col("o_custkey") % 2).alias("itin_id"), F.when(k % 2 == 0, "rail").otherwise("bus").alias("mode"),
        S.pick(["Northbound", "Southbound", "Eastbound"], k % 3).alias("line"),
        F.when(k % 6 == 0, "40380").when(k % 2 == 0, "40010").otherwise("120").alias("stop_id"),
        (k % 20).alias("position"), F.lit(20).alias("total"), local.alias("local"))
    days = o.select(F.col("o_orderdate").cast("date").alias("date")).where(F.date_format("date", "MM-dd").isin("07-04", "12-25"))
    return V.crowding_by_itinerary(legs, days)
