"""Registered queries: stateful jobs, in batch and as streams over the same tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import analytics as A
from ..operators import limits as M
from ..operators import tracking as K
from ..session import scratch_path
from ..sources import adapters as S
from ..streaming import jobs as J
from .analytics_queries import STAGES_SQL, array_text, day_text, sessions_cte
from .registry import query
from .views import with_views

TIGHT = M.Limit(2, 6, 20)


def stream(spark, sf_dir, name="events"):
    """A table as a file stream."""
    schema = S.table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}*.parquet")


#: The rule by recursion over each address's requests; the hourly list also takes what the daily quota refuses.
DECIDED = """WITH RECURSIVE v AS (SELECT event_id AS visit_id, user_id,
      epoch_us(TIMESTAMP '2024-01-01') + (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) // 2000 AS us FROM events),
    q AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY us, visit_id) AS n FROM v),
    s(user_id, n, visit_id, us, recent, daily, allowed) AS (
      SELECT DISTINCT user_id, 0::BIGINT, NULL::BIGINT, NULL::BIGINT, []::BIGINT[], []::BIGINT[], false FROM q UNION ALL
      SELECT user_id, n, visit_id, us, CASE WHEN ok THEN list_append(rec, us) ELSE rec END,
             CASE WHEN ok AND len(day) < 20 THEN list_append(day, us) ELSE day END, ok AND len(day) < 20
      FROM (SELECT *, len(rec) < 6 AND len(list_filter(rec, lambda x: us - x <= 60000000)) < 2 AS ok
            FROM (SELECT q.*, list_filter(recent, lambda x: q.us - x <= 3600000000) AS rec, list_filter(daily, lambda x: q.us - x <= 86400000000) AS day
                  FROM s JOIN q ON q.user_id = s.user_id AND q.n = s.n + 1)))"""
ALLOWED = DECIDED + " SELECT visit_id, us, allowed FROM s WHERE n > 0"


@query("rate_limit", ALLOWED)
def rate_limit(spark, sf_dir):
    return M.rate_limit(S.dense_requests(S.visits(spark, sf_dir)), TIGHT).select("visit_id", "us", "allowed")


@query("rate_limit_summary", DECIDED + """ SELECT count(*) AS requests, count(*) FILTER (allowed) AS allowed
    FROM s WHERE n > 0 GROUP BY user_id""")
def rate_limit_summary(spark, sf_dir):
    return M.limit_summary(M.rate_limit(S.dense_requests(S.visits(spark, sf_dir)), TIGHT)).drop("ip")


@query("stream_rate_limit", ALLOWED)
def stream_rate_limit(spark, sf_dir):
    dense = S.dense_requests(S.visits_from_events(stream(spark, sf_dir)))
    return J.to_table(J.stream_rate_limit(dense, TIGHT), "limits").select("visit_id", "us", "allowed")


@query("stream_rate_limit_in_order", ALLOWED + " AND us <= (SELECT max(us) // 1000 * 1000 FROM s) - 60000000")
def stream_rate_limit_in_order(spark, sf_dir):
    """What the watermark has passed by the end of the input."""
    dense = S.dense_requests(S.visits_from_events(stream(spark, sf_dir)))
    return J.to_table(J.stream_rate_limit(dense, TIGHT, in_order=True), "limits").select("visit_id", "us", "allowed")


@query("stream_daily_counters", with_views(["v_visits"], """
    SELECT CAST(day AS VARCHAR) AS date, count(*) AS visits, count(CASE WHEN ua IN (0, 5) AND path = '/ping' THEN 1 END) AS mobile,
           count(CASE WHEN event_name = 'app_loaded' THEN 1 END) AS app_loaded, count(CASE WHEN path = '/recommend' THEN 1 END) AS searches FROM v_visits GROUP BY 1"""))
def stream_daily_counters(spark, sf_dir):
    path = scratch_path(spark, "daily")
    J.stream_daily_counters(S.visits_from_events(stream(spark, sf_dir)), path, path + "-state")
    d = spark.read.parquet(path)
    return day_text(d.select("date", "visits", "mobile", "app_loaded", F.aggregate(
        "hours", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("searches")), "date")


@query("stream_daily_visitors", with_views(["v_visits"], """
    SELECT CAST(day AS VARCHAR) AS day, count(DISTINCT ip) AS "count" FROM v_visits GROUP BY 1"""))
def stream_daily_visitors(spark, sf_dir):
    t = J.to_table(J.daily_visitors(S.visits_from_events(stream(spark, sf_dir))), "visitors")
    return day_text(t.groupBy("day").agg(F.count("*").alias("count")))


@query("stream_sessions", with_views(["v_visits"], """
    SELECT sid, CAST(day AS VARCHAR) AS day, start_us, last_us, visits, recommends, CAST(coalesce(stage, -1) AS INTEGER) AS stage FROM v_sessions
    WHERE last_us + 1800000000 < (SELECT max(us) FROM v_visits) - 600000000""", sessions_cte(1800)))
def stream_sessions(spark, sf_dir):
    """Sessions the watermark has closed by the end of the input."""
    return day_text(J.to_table(J.stream_sessions(S.visits_from_events(stream(spark, sf_dir))), "sessions"))


@query("stream_sessions_with_events", with_views(["v_visits"], """
    SELECT sid, CAST(day AS VARCHAR) AS day, start_us, last_us, visits, recommends, CAST(coalesce(max(e.stage), -1) AS INTEGER) AS stage
    FROM v_sessions s LEFT JOIN v_named e ON e.esid = sid AND e.eday = day AND e.eus BETWEEN start_us AND last_us + 21600000000
    WHERE last_us + 21600000000 < (SELECT max(us) FROM v_visits) - 600000000 GROUP BY ALL""",
    f"""v_named AS (SELECT sid AS esid, day AS eday, us AS eus, list_position({STAGES_SQL}, event_name) - 1 AS stage FROM v_visits
      WHERE event_name IN ('recommend_returned', 'trip_completed')), """
    + sessions_cte(21600, "v_visits WHERE event_name NOT IN ('recommend_returned', 'trip_completed')")))
def stream_sessions_with_events(spark, sf_dir):
    """Visits and named events as two streams; sessions that are over by the end of the input."""
    rows, named = S.visits_from_events(stream(spark, sf_dir)), F.col("event_name").isin("recommend_returned", "trip_completed")
    return day_text(J.to_table(J.stream_sessions(rows.where(~named), rows.where(named), gap_seconds=21600), "sessions"))


@query("stream_retention", with_views(["v_visits"], """
    SELECT CAST(day AS VARCHAR) AS day, count(CASE WHEN day = first_day THEN 1 END) AS "new", count(CASE WHEN day > first_day THEN 1 END) AS returning
    FROM (SELECT sid, day, min(day) OVER (PARTITION BY sid) AS first_day FROM (SELECT DISTINCT sid, day FROM v_visits WHERE path = '/ping')) GROUP BY 1"""))
def stream_retention(spark, sf_dir):
    t = J.to_table(J.stream_retention(S.visits_from_events(stream(spark, sf_dir))), "retention")
    return t.groupBy("day").agg(F.count_if(~F.col("returning")).alias("new"), F.count_if("returning").alias("returning"))


def arrivals_of(events):
    u = F.col("user_id")
    return events.select(
        F.lit("bus").alias("mode"), (u % 7).cast("string").alias("line_code"), (u % 20).cast("string").alias("stop_id"),
        F.col("event_type").alias("destination"), F.floor("value").cast("int").alias("minutes"), F.col("ts").alias("fetched_at"))


@query("latest_predictions", """
    SELECT epoch_us(ts) // 30000000 AS slot, CAST(user_id % 7 AS VARCHAR) AS line_code, CAST(user_id % 20 AS VARCHAR) AS stop_id, event_type AS destination,
           CAST(arg_max(floor(value), ts) AS INTEGER) AS minutes FROM events GROUP BY ALL""")
def latest_predictions(spark, sf_dir):
    p = J.latest_predictions(arrivals_of(S.table(spark, sf_dir, "events")))
    return p.select(F.floor(F.unix_timestamp("slot") / 30).alias("slot"), "line_code", "stop_id", "destination", "minutes")


@query("stream_stop_board")
def stream_stop_board(spark, sf_dir):
    path = scratch_path(spark, "board")
    pins = S.table(spark, sf_dir, "supplier").select(F.lit("bus").alias("mode"), (F.col("s_suppkey") % 25).cast("string").alias("stop_id"))
    J.stream_stop_board(arrivals_of(stream(spark, sf_dir)), pins, path, path + "-state")
    return spark.read.parquet(path).select("key", F.to_json("arrivals").alias("arrivals"))


@query("stream_alerts", """SELECT CAST(user_id AS VARCHAR) AS alert_id, 1::BIGINT AS shown FROM events GROUP BY 1""")
def stream_alerts(spark, sf_dir):
    e = stream(spark, sf_dir).select(F.col("user_id").cast("string").alias("alert_id"), F.col("ts").alias("fetched_at"))
    t = J.to_table(J.stream_alerts(e), "alerts")
    return t.groupBy("alert_id").agg(F.count("*").alias("shown"))


def trip_inputs(spark, sf_dir, events):
    """Pings wander along legs laid out from the orders of the same number."""
    u = F.col("user_id")
    lat, lon = S.lat_of(u), S.lon_of(u, 2741)
    n = F.hour("ts") % 4
    pings = events.select(
        u.alias("trip_id"), "ts", (lat + n * 0.002 + F.col("value") / 1e5).alias("lat"), lon.alias("lon"),
        (F.col("event_type") == "click").alias("on_vehicle"), (F.col("event_type") == "signup").alias("rerouted"))
    k = F.col("c_custkey")
    pt = lambda i: F.struct((S.lat_of(k) + i * 0.002).alias("lat"), S.lon_of(k, 2741).alias("lon"))
    one = lambda i, t: F.struct(
        F.lit(i).alias("leg_no"), F.lit(t).alias("leg_type"), F.array(pt(i), pt(i + 1)).alias("path"), F.array(pt(i)).alias("steps"))
    legs = S.table(spark, sf_dir, "customer").select(k.alias("trip_id"), F.inline(F.array(one(0, "walk"), one(1, "transit"), one(2, "walk"))))
    return pings, legs


@query("track_trips")
def track_trips(spark, sf_dir):
    return K.track_trips(*trip_inputs(spark, sf_dir, S.table(spark, sf_dir, "events")))


@query("stream_trips")
def stream_trips(spark, sf_dir):
    return J.to_table(J.stream_trips(*trip_inputs(spark, sf_dir, stream(spark, sf_dir))), "trips")
