"""The adapter views in SQL, for checking the registered queries."""

from __future__ import annotations

#: Every line item with its place in its order, as line numbers repeat.
LINES = """(SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey,
   l_extendedprice) AS ln, l_partkey AS p, l_suppkey FROM lineitem)"""

VIEWS: dict[str, tuple[list[str], str]] = {
    "v_visits": ([], """
        SELECT event_id AS visit_id, ts,
               CASE WHEN event_type IN ('click','purchase') THEN '/recommend' ELSE '/ping' END AS path,
               (user_id * 2862933) % 4294967296 AS ip,
               CAST(floor(value) AS BIGINT) % 6 AS ua,
               CAST(user_id AS VARCHAR) AS sid,
               CASE event_type WHEN 'view' THEN 'app_loaded' WHEN 'click' THEN 'recommend_submitted'
                    WHEN 'signup' THEN 'recommend_returned' WHEN 'purchase' THEN 'trip_completed'
                    ELSE event_type END AS event_name,
               (ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/Chicago' AS lts,
               CAST((ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/Chicago' AS DATE) AS day,
               epoch_us(ts) AS us
        FROM events"""),
    "v_networks": ([], """
        SELECT CAST(n_nationkey AS BIGINT) * 171798691 AS start_ip,
               CAST(n_nationkey AS BIGINT) * 171798691 + 120000000 AS end_ip, n_name AS city
        FROM nation"""),
    "v_by_city": (["v_visits", "v_networks"], """
        SELECT v.day, n.city, count(*) AS n FROM v_visits v
        JOIN v_networks n ON v.ip BETWEEN n.start_ip AND n.end_ip GROUP BY ALL"""),
    "v_referers": ([], r"""
        SELECT DATE '2024-01-01' + CAST(page_id % 30 AS INTEGER) AS day,
               nullif(lower(regexp_extract(url, '^\s*(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?//(?:[^/?#]*@)?([^/?#:]*)', 1)), '') AS host
        FROM pages"""),
    "v_stops_all": ([], """
        SELECT CASE p_partkey % 4 WHEN 0 THEN (p_partkey // 4) % 10000 + 40000
                    WHEN 1 THEN (p_partkey // 4) % 10000 + 30000 ELSE p_partkey % 30000 END AS stop_id,
               p_name || ' & ' || p_brand AS name,
               41.64 + (p_partkey * 7919 % 3800) / 10000.0 AS lat,
               -87.94 + ((p_partkey * p_partkey * 31 + p_partkey * 17) % 4200) / 10000.0 AS lon,
               CASE WHEN p_partkey % 4 = 1 THEN (p_partkey // 4) % 10000 + 40000 END AS parent_id
        FROM part"""),
    "v_stops": (["v_stops_all"], """
        SELECT stop_id, arg_min(name, struct_pack(a := name, b := lat, c := lon)) AS name,
               arg_min(lat, struct_pack(a := name, b := lat, c := lon)) AS lat,
               arg_min(lon, struct_pack(a := name, b := lat, c := lon)) AS lon,
               min(parent_id) AS parent_id,
               CASE WHEN stop_id >= 40000 THEN 'station' WHEN stop_id >= 30000 THEN 'platform'
                    ELSE 'bus' END AS kind
        FROM v_stops_all GROUP BY stop_id"""),
    "v_routes": ([], """
        SELECT 'R' || n AS route_id, CASE WHEN n % 7 = 0 THEN 'R' || n ELSE CAST(n AS VARCHAR) END AS short_name,
               'Route ' || n AS long_name, CASE WHEN n < 8 THEN '1' ELSE '3' END AS route_type,
               CASE WHEN n % 5 = 0 THEN 'b71234' WHEN n % 5 = 1 THEN '414145' ELSE '565a5c' END AS color,
               CASE WHEN n < 8 THEN 'rail' ELSE 'bus' END AS mode
        FROM (SELECT DISTINCT c_custkey % 40 AS n FROM customer)"""),
    "v_trips": ([], """
        SELECT o_orderkey AS trip_id, 'R' || (o_custkey % 40) AS route_id,
               'S' || substr(o_orderpriority, 1, 1) AS service_id,
               CAST(o_orderkey % 2 AS VARCHAR) AS direction_id,
               'H' || (o_custkey % 40) || '-' || (o_orderkey % 3) AS shape_id,
               'To ' || o_orderstatus AS headsign
        FROM orders"""),
    "v_stop_times": ([], """
        SELECT l_orderkey AS trip_id, ln AS seq, l_orderkey * 37 % 1700 + ln * 4 AS dep_min,
               CASE p % 4 WHEN 0 THEN (p // 4) % 10000 + 40000
                    WHEN 1 THEN (p // 4) % 10000 + 30000 ELSE p % 30000 END AS stop_id
        FROM """ + LINES),
    "v_services": ([], """
        SELECT * FROM (VALUES ('S1',0),('S1',1),('S1',2),('S1',3),('S1',4),('S2',5),('S3',6),
          ('S4',5),('S4',6),('S5',0),('S5',1),('S5',2),('S5',3),('S5',4),('S5',5),('S5',6)) AS t(service_id, dow)"""),
    "v_calendar_dates": ([], """
        SELECT service_id, d, CASE WHEN n % 2 = 0 THEN '2' ELSE '1' END AS exception_type
        FROM (SELECT 'S' || substr(o_orderpriority, 1, 1) AS service_id, CAST(o_orderdate AS DATE) AS d, count(*) AS n
              FROM orders GROUP BY ALL) WHERE n % 3 = 0"""),
    "v_service_days": (["v_services", "v_calendar_dates"], """
        SELECT service_id, dow FROM v_services UNION
        SELECT service_id, isodow(d) - 1 AS dow FROM v_calendar_dates WHERE exception_type = '1'
        GROUP BY ALL HAVING count(*) >= 3"""),
    "v_trip_stops": (["v_stop_times", "v_trips", "v_routes", "v_stops"], """
        SELECT trip_id, route_id, direction_id, service_id, mode, stop_id, dep_min, platform_id, seq,
               row_number() OVER (PARTITION BY trip_id ORDER BY seq, dep_min, platform_id) - 1 AS pos,
               count(*) OVER (PARTITION BY trip_id) AS n_stops,
               first_value(dep_min) OVER (PARTITION BY trip_id ORDER BY seq) AS first_min
        FROM (SELECT st.trip_id, t.route_id, t.direction_id, t.service_id, r.mode, st.seq, st.dep_min,
                     st.stop_id AS platform_id,
                     CASE WHEN r.mode = 'rail' THEN coalesce(s.parent_id, st.stop_id) ELSE st.stop_id END AS stop_id
              FROM v_stop_times st JOIN v_trips t ON st.trip_id = t.trip_id JOIN v_routes r USING (route_id)
              LEFT JOIN v_stops s ON s.stop_id = st.stop_id
              WHERE r.mode = 'rail' OR s.kind = 'bus')"""),
    "v_periods": ([], """
        SELECT * FROM (VALUES
          ('weekday_peak',[0,1,2,3,4],360,570,480),('weekday_peak',[0,1,2,3,4],930,1140,480),
          ('weekday_midday',[0,1,2,3,4],570,930,720),('weekday_evening',[0,1,2,3,4],1140,1320,1230),
          ('weekend',[5,6],300,1320,720),('owl',[0,1,2,3,4,5,6],1320,1440,120),
          ('owl',[0,1,2,3,4,5,6],0,300,120)) AS t(period, days, start_min, end_min, target_min)"""),
    "v_trip_periods": (["v_trip_stops", "v_service_days", "v_periods"], """
        SELECT DISTINCT t.trip_id, p.period, p.target_min
        FROM (SELECT DISTINCT trip_id, service_id, first_min FROM v_trip_stops) t
        JOIN v_service_days d USING (service_id)
        JOIN v_periods p ON list_contains(p.days, CAST((d.dow + t.first_min // 1440) % 7 AS INTEGER))
         AND t.first_min % 1440 >= p.start_min AND t.first_min % 1440 < p.end_min"""),
    "v_reps": (["v_trip_stops", "v_trip_periods"], """
        SELECT period, route_id, direction_id, mode, trip_id, n_stops FROM (
          SELECT p.period, t.route_id, t.direction_id, t.mode, t.trip_id, t.n_stops,
                 row_number() OVER (PARTITION BY p.period, t.route_id, t.direction_id ORDER BY
                   CASE WHEN t.mode = 'rail' THEN -t.n_stops ELSE 0 END,
                   abs(t.first_min - p.target_min), CAST(t.trip_id AS VARCHAR)) AS rn
          FROM (SELECT DISTINCT trip_id, route_id, direction_id, mode, n_stops, first_min FROM v_trip_stops) t
          JOIN v_trip_periods p USING (trip_id)) WHERE rn = 1"""),
    "v_rep_stops": (["v_reps", "v_trip_stops"], """
        SELECT r.period, s.* FROM v_reps r JOIN v_trip_stops s USING (trip_id)"""),
}


def with_views(names: list[str], body: str, extra: str = "") -> str:
    """`WITH` the views (and what they need) followed by `body`."""
    order: list[str] = []

    def visit(n: str) -> None:
        for d in VIEWS[n][0]:
            visit(d)
        if n not in order:
            order.append(n)

    for n in names:
        visit(n)
    ctes = [f"{n} AS ({VIEWS[n][1]})" for n in order]
    if extra:
        ctes.append(extra)
    return "WITH " + ",\n".join(ctes) + "\n" + body
