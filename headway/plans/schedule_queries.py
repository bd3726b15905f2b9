"""Registered queries: schedule processing."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import crowding as C
from ..functions.timecode import local_ts, service_period, sunday_service_holiday
from ..operators import schedule as G
from ..sources import adapters as S
from ..sources.gtfs import coerce
from ..sources.sinks import file_safe
from .analytics_queries import array_text
from .feed import Feed
from .registry import query
from .views import with_views

ID = "CAST({} AS VARCHAR)"
HHMM = "lpad(CAST(({0} // 60) % 24 AS VARCHAR), 2, '0') || ':' || lpad(CAST({0} % 60 AS VARCHAR), 2, '0')"
TEXT = "lpad(CAST({0} // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST({0} % 60 AS VARCHAR), 2, '0') || ':00'"
BUCKETS_CTE = """v_buckets AS (SELECT * FROM (VALUES ('S1','weekday'),('S2','saturday'),('S3','sunday'),
   ('S4','saturday'),('S4','sunday'),('S5','weekday'),('S5','saturday'),('S5','sunday')) AS t(service_id, bucket)
   UNION SELECT service_id, 'sunday' FROM v_calendar_dates WHERE exception_type = '1' AND (
     strftime(d, '%m-%d') IN ('01-01','07-04','12-25')
     OR (month(d) = 5 AND isodow(d) = 1 AND month(d + 7) = 6)
     OR (month(d) = 9 AND isodow(d) = 1 AND day(d) <= 7)
     OR (month(d) = 11 AND isodow(d) = 4 AND day(d) BETWEEN 22 AND 28)))"""
CALLS_CTE = BUCKETS_CTE + f""", v_calls AS (SELECT t.route_id, t.direction_id, st.stop_id, b.bucket, st.seq, st.trip_id,
   t.headsign, {HHMM.format('st.dep_min')} AS hhmm
   FROM v_stop_times st JOIN v_trips t USING (trip_id) JOIN v_buckets b USING (service_id))"""


@query("feed_rows", with_views(["v_stops_all", "v_routes", "v_trips", "v_stop_times", "v_calendar_dates"], """
    SELECT 'stops' AS name, (SELECT count(*) FROM v_stops_all) AS n
    UNION ALL SELECT 'routes', (SELECT count(*) FROM v_routes)
    UNION ALL SELECT 'trips', (SELECT count(*) FROM v_trips)
    UNION ALL SELECT 'stop_times', (SELECT count(*) FROM v_stop_times)
    UNION ALL SELECT 'transfers', (SELECT count(*) FROM part)
    UNION ALL SELECT 'shapes', (SELECT count(*) FROM customer)
    UNION ALL SELECT 'calendar', 5
    UNION ALL SELECT 'calendar_dates', (SELECT count(*) FROM v_calendar_dates)"""))
def feed_rows(spark, sf_dir):
    """Rows of each feed table that survive coercion."""
    out = None
    for name, df in coerce(S.gtfs(spark, sf_dir))[0].items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("classify_stops", with_views(["v_stops"], """
    SELECT CAST(stop_id AS VARCHAR) AS stop_id, kind, name, round(lat, 6) AS lat, round(lon, 6) AS lon,
           CAST(parent_id AS VARCHAR) AS parent_id FROM v_stops"""))
def classify_stops(spark, sf_dir):
    return Feed.from_tables(spark, sf_dir).stops.select(
        "stop_id", "kind", "name", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"),
        "parent_id")


@query("classify_routes", with_views(["v_routes"], """
    SELECT route_id, short_name, long_name, mode, CASE WHEN route_type = '1' THEN 'train'
        WHEN color = 'b71234' THEN 'bus_express' WHEN color = '414145' THEN 'bus_frequent'
        ELSE 'bus_regular' END AS category FROM v_routes"""))
def classify_routes(spark, sf_dir):
    return Feed.from_tables(spark, sf_dir).routes.select(
        "route_id", "short_name", "long_name", "mode", "category")


@query("natural_route_order", with_views(["v_routes"], r"""
    SELECT short_name, CASE WHEN regexp_matches(short_name, '^\d+$') THEN 0 ELSE 1 END AS sort_group,
        CAST(regexp_extract(short_name, '(\d+)', 1) AS BIGINT) AS sort_number,
        CASE WHEN regexp_matches(short_name, '^\d+$') THEN '' ELSE 'R' END AS sort_letters,
        CASE WHEN regexp_matches(short_name, '^\d+$') THEN 'numbers' ELSE 'other' END AS picker FROM v_routes"""))
def natural_route_order(spark, sf_dir):
    r = G.natural_route_order(Feed.from_tables(spark, sf_dir).routes)
    return r.select("short_name", "sort_group", "sort_number", "sort_letters",
                    G.alert_picker_group(F.col("short_name")).alias("picker"))


@query("service_days", with_views(["v_service_days"],
       "SELECT service_id, CAST(dow AS INTEGER) AS dow FROM v_service_days"))
def service_days(spark, sf_dir):
    return Feed.from_tables(spark, sf_dir).days


@query("service_buckets", with_views(["v_calendar_dates"], "SELECT service_id, bucket FROM v_buckets", BUCKETS_CTE))
def service_buckets(spark, sf_dir):
    return Feed.from_tables(spark, sf_dir).buckets


@query("feed_window", with_views(["v_calendar_dates"], """
    SELECT CAST(min(d) AS VARCHAR) AS start_date, CAST(max(d) AS VARCHAR) AS end_date FROM v_calendar_dates"""))
def feed_window(spark, sf_dir):
    dates = Feed.from_tables(spark, sf_dir).tables["calendar_dates"]
    span = dates.select(F.col("date").alias("start_date"), F.col("date").alias("end_date"))
    return G.feed_window(span).select(*[F.col(c).cast("string").alias(c) for c in ("start_date", "end_date")])


@query("to_parent", with_views(["v_stop_times", "v_stops"], """
    SELECT CAST(coalesce(s.parent_id, t.stop_id) AS VARCHAR) AS stop_id, count(*) AS calls
    FROM v_stop_times t LEFT JOIN v_stops s USING (stop_id) GROUP BY 1"""))
def to_parent(spark, sf_dir):
    f = Feed.from_tables(spark, sf_dir)
    return G.to_parent(f.tables["stop_times"], f.stops).groupBy("stop_id").agg(F.count("*").alias("calls"))


@query("trip_stops", with_views(["v_trip_stops"], """
    SELECT CAST(trip_id AS VARCHAR) AS trip_id, route_id, direction_id, mode, CAST(stop_id AS VARCHAR) AS stop_id,
           CAST(pos AS INTEGER) AS pos, n_stops, CAST(dep_min AS DOUBLE) AS arr_min, CAST(first_min AS DOUBLE) AS first_min
    FROM v_trip_stops"""))
def trip_stops(spark, sf_dir):
    return Feed.from_tables(spark, sf_dir).sequences.select(
        "trip_id", "route_id", "direction_id", "mode", "stop_id", "pos", "n_stops", "arr_min", "first_min")


@query("trip_periods", with_views(["v_trip_periods"],
       "SELECT CAST(trip_id AS VARCHAR) AS trip_id, period, target_min FROM v_trip_periods"))
def trip_periods(spark, sf_dir):
    return Feed.from_tables(spark, sf_dir).periods


@query("representative_trips", with_views(["v_reps"], """
    SELECT period, route_id, direction_id, mode, CAST(trip_id AS VARCHAR) AS trip_id, n_stops FROM v_reps"""))
def representative_trips(spark, sf_dir):
    return Feed.from_tables(spark, sf_dir).reps


@query("last_departures", with_views(["v_trip_stops"], f"""
    SELECT route_id, direction_id, CAST(stop_id AS VARCHAR) AS stop_id,
           {TEXT.format('max(dep_min)')} AS dep_text FROM v_trip_stops WHERE mode = 'rail' GROUP BY ALL"""))
def last_departures(spark, sf_dir):
    return G.last_departures(Feed.from_tables(spark, sf_dir).calls).drop("dep_min")


@query("until_last", with_views(["v_trip_stops"], f"""
    SELECT route_id, direction_id, CAST(stop_id AS VARCHAR) AS stop_id, {HHMM.format('m')} AS time,
           CASE WHEN m >= 1350 THEN CAST(m - 1350 AS INTEGER) END AS minutes_until, m < 1350 AS departed
    FROM (SELECT route_id, direction_id, stop_id, max(dep_min) AS m FROM v_trip_stops WHERE mode = 'rail' GROUP BY ALL)"""))
def until_last(spark, sf_dir):
    now = F.lit("2024-01-10 22:30:00").cast("timestamp_ntz")
    return G.until_last(G.last_departures(Feed.from_tables(spark, sf_dir).calls), now)


VIEWS_TT = ["v_stop_times", "v_trips", "v_calendar_dates"]


@query("timetable", with_views(VIEWS_TT, """
    SELECT route_id, direction_id, CAST(stop_id AS VARCHAR) AS stop_id, bucket,
           string_agg(DISTINCT hhmm, ',' ORDER BY hhmm) AS times, min(seq) AS first_seq
    FROM v_calls GROUP BY ALL""", CALLS_CTE))
def timetable(spark, sf_dir):
    return array_text(G.timetable(Feed.from_tables(spark, sf_dir).timetable_calls), "times")


@query("stop_order", with_views(VIEWS_TT, """
    SELECT route_id, direction_id, CAST(stop_id AS VARCHAR) AS stop_id, seq,
           CAST(row_number() OVER (PARTITION BY route_id, direction_id ORDER BY seq, CAST(stop_id AS VARCHAR)) - 1 AS INTEGER) AS stop_no
    FROM (SELECT route_id, direction_id, stop_id, min(seq) AS seq FROM v_calls GROUP BY ALL)""", CALLS_CTE))
def stop_order(spark, sf_dir):
    return G.stop_order(Feed.from_tables(spark, sf_dir).timetable_calls)


@query("headsigns", with_views(VIEWS_TT, """
    SELECT route_id, direction_id, arg_min(headsign, struct_pack(a := CAST(trip_id AS VARCHAR), b := seq)) AS headsign
    FROM v_calls GROUP BY ALL""", CALLS_CTE))
def headsigns(spark, sf_dir):
    return G.headsigns(Feed.from_tables(spark, sf_dir).timetable_calls)


@query("timetable_documents", with_views(VIEWS_TT, """
    SELECT route_id, count(DISTINCT direction_id) AS directions,
           count(DISTINCT direction_id || '/' || stop_id) AS stops,
           count(DISTINCT concat_ws('/', direction_id, stop_id, bucket, hhmm)) AS times
    FROM v_calls GROUP BY ALL""", CALLS_CTE))
def timetable_documents(spark, sf_dir):
    """The nested documents, counted back from inside."""
    f = Feed.from_tables(spark, sf_dir)
    docs = G.timetable_documents(f.timetable_calls, f.routes, f.tables["stops"]
                                 .select("stop_id", "name", "lat", "lon"))
    d = docs.select("route_id", F.explode("directions").alias("d")).select(
        "route_id", "d.direction_id", F.explode("d.stops").alias("s"))
    n = F.size("s.times.weekday") + F.size("s.times.saturday") + F.size("s.times.sunday")
    return d.groupBy("route_id").agg(
        F.count_distinct("direction_id").alias("directions"), F.count("*").alias("stops"),
        F.sum(n).alias("times"))


@query("timetable_by_hour", with_views(VIEWS_TT, """
    SELECT route_id, direction_id, CAST(stop_id AS VARCHAR) AS stop_id, CAST(hhmm[1:2] AS INTEGER) AS hour,
           string_agg(DISTINCT hhmm[4:5], ',' ORDER BY hhmm[4:5]) AS minutes
    FROM v_calls WHERE bucket = 'sunday' GROUP BY ALL""", CALLS_CTE))
def timetable_by_hour(spark, sf_dir):
    holiday = F.lit("2024-07-04").cast("date")
    return array_text(G.timetable_by_hour(Feed.from_tables(spark, sf_dir).timetable_calls, holiday), "minutes")


@query("stop_routes", with_views(["v_trip_stops"], """
    SELECT CAST(stop_id AS VARCHAR) AS stop_id, string_agg(DISTINCT route_id, ',' ORDER BY route_id) AS routes
    FROM v_trip_stops GROUP BY 1"""))
def stop_routes(spark, sf_dir):
    return array_text(G.stop_routes(Feed.from_tables(spark, sf_dir).calls), "routes")


@query("stop_entries", with_views(["v_rep_stops"], """
    SELECT period, CAST(stop_id AS VARCHAR) AS stop_id, route_id, direction_id, CAST(pos AS INTEGER) AS pos,
           CAST(dep_min AS DOUBLE) AS arr_min FROM v_rep_stops"""))
def stop_entries(spark, sf_dir):
    return G.stop_entries(Feed.from_tables(spark, sf_dir).rep_stops)


@query("stop_positions", with_views(["v_rep_stops", "v_trip_stops"], """
    SELECT CAST(a.stop_id AS VARCHAR) AS stop_id, a.route_id, CAST(coalesce(position, 1) AS INTEGER) AS position,
           coalesce(total, 2) AS total FROM a
    LEFT JOIN (SELECT * FROM p WHERE period = 'weekday_midday') p ON p.stop_id = a.stop_id AND p.route_id = a.route_id""", """
    p AS (SELECT period, stop_id, route_id, arg_min(pos, struct_pack(d := direction_id, p := pos)) AS position,
                 arg_min(n_stops, struct_pack(d := direction_id, p := pos)) AS total FROM v_rep_stops GROUP BY ALL),
    a AS (SELECT DISTINCT stop_id, route_id FROM v_trip_stops)"""))
def stop_positions(spark, sf_dir):
    f = Feed.from_tables(spark, sf_dir)
    asked = f.calls.select("stop_id", "route_id").distinct().withColumn("period", F.lit("weekday_midday"))
    return G.locate(asked, G.stop_positions(f.rep_stops)).drop("period")


SHAPES_CTE = """v_shapes AS (SELECT 'H' || (c_custkey % 40) || '-' || ((c_custkey // 40) % 4) AS shape_id FROM customer)"""


@query("used_shapes", with_views(["v_trips"], """
    SELECT 'H' || (c_custkey % 40) || '-' || ((c_custkey // 40) % 4) AS shape_id, CAST(c_custkey // 40 AS INTEGER) AS seq,
      round(41.64 + (c_custkey * 7919 % 3800) / 10000.0, 5) AS lat, round(-87.94 + ((c_custkey * c_custkey * 31 + c_custkey * 17) % 4200) / 10000.0, 5) AS lon
    FROM customer WHERE 'H' || (c_custkey % 40) || '-' || ((c_custkey // 40) % 4) IN (SELECT shape_id FROM v_trips)"""))
def used_shapes(spark, sf_dir):
    f = Feed.from_tables(spark, sf_dir).tables
    return G.used_shapes(f["shapes"], f["trips"]).select("shape_id", F.col("seq").cast("int").alias("seq"), F.round("lat", 5).alias("lat"), F.round("lon", 5).alias("lon"))


@query("shape_per_route", with_views(["v_trips", "v_routes"], """
    SELECT route_id AS route_key, direction_id, m.shape_id AS shape_id, m.points AS points FROM j
    UNION SELECT short_name, direction_id, m.shape_id, m.points FROM j""", SHAPES_CTE + """,
    n AS (SELECT shape_id, count(*) AS points FROM v_shapes GROUP BY 1),
    c AS (SELECT DISTINCT route_id, direction_id, shape_id FROM v_trips),
    m AS (SELECT route_id, direction_id, max(struct_pack(points := points, shape_id := shape_id)) AS m
          FROM c JOIN n USING (shape_id) GROUP BY ALL),
    j AS (SELECT m.*, r.short_name FROM m JOIN v_routes r USING (route_id))"""))
def shape_per_route(spark, sf_dir):
    f = Feed.from_tables(spark, sf_dir)
    return G.shape_per_route(f.tables["shapes"], f.tables["trips"], f.routes)


@query("service_periods", with_views(["v_visits"], """
    SELECT visit_id, CASE WHEN m >= 1320 OR m < 300 THEN 'owl' WHEN d > 5 THEN 'weekend' WHEN m BETWEEN 360 AND 569 OR m BETWEEN 930 AND 1139 THEN 'weekday_peak'
        WHEN m BETWEEN 1140 AND 1319 THEN 'weekday_evening' ELSE 'weekday_midday' END AS service,
      CASE WHEN d > 5 THEN 'weekend' ELSE 'weekday' END AS day_type,
      CASE WHEN d > 5 THEN CASE WHEN m BETWEEN 540 AND 1259 THEN 'regular' ELSE 'off_peak' END WHEN m BETWEEN 390 AND 569 OR m BETWEEN 930 AND 1109 THEN 'peak'
        WHEN m BETWEEN 570 AND 929 OR m BETWEEN 1110 AND 1259 THEN 'regular' ELSE 'off_peak' END AS crowding
    FROM (SELECT visit_id, hour(lts) * 60 + minute(lts) AS m, isodow(lts) AS d FROM v_visits)"""))
def service_periods(spark, sf_dir):
    """Service period, day type and crowding period of every visit."""
    lt = local_ts(F.col("ts"))
    v = S.visits(spark, sf_dir).select("visit_id", lt.alias("lt"))
    day = C.day_type(F.col("lt"), F.lit(False))
    return v.select("visit_id", service_period(F.col("lt")).alias("service"), day.alias("day_type"),
                    C.time_period(F.col("lt"), day).alias("crowding"))


@query("sunday_service_days", """SELECT CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day, count(*) AS orders FROM orders WHERE
      strftime(o_orderdate, '%m-%d') IN ('01-01','07-04','12-25') OR (month(o_orderdate) = 5 AND isodow(o_orderdate) = 1 AND month(o_orderdate + INTERVAL 7 DAY) = 6)
      OR (month(o_orderdate) = 9 AND isodow(o_orderdate) = 1 AND day(o_orderdate) <= 7) OR (month(o_orderdate) = 11 AND isodow(o_orderdate) = 4 AND day(o_orderdate) BETWEEN 22 AND 28)
    GROUP BY 1""")
def sunday_service_days(spark, sf_dir):
    d = S.table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("day"))
    return d.where(sunday_service_holiday(F.col("day"))).groupBy(F.col("day").cast("string").alias("day")).agg(F.count("*").alias("orders"))


@query("route_files", with_views(["v_routes"], r"""
    SELECT route_id, regexp_replace(route_id || '/' || long_name, '[^A-Za-z0-9_\-]', '_', 'g') AS file FROM v_routes"""))
def route_files(spark, sf_dir):
    """File-safe names, over ids made awkward on purpose."""
    r = Feed.from_tables(spark, sf_dir).routes
    return r.select("route_id", file_safe(F.concat_ws("/", "route_id", "long_name")).alias("file"))
