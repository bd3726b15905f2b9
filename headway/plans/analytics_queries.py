"""Registered queries: daily product analytics and the public panels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.web import DEVICE_BUCKETS, daily_key, hmac_sha256
from ..functions.timecode import local_date
from ..operators import analytics as A
from ..operators import panels as P
from ..sources import adapters as S
from .registry import query
from .views import with_views

STAGES_SQL = "['app_loaded','recommend_submitted','recommend_returned','route_selected','start_route_tapped','trip_completed']"
METRO = ["nation_1", "Nation_7", "NATION_12", "NATION_20"]


def day_text(df: DataFrame, name: str = "day") -> DataFrame:
    return df.withColumn(name, F.col(name).cast("string"))


def array_text(df: DataFrame, *names: str) -> DataFrame:
    for n in names:
        df = df.withColumn(n, F.array_join(F.transform(F.col(n), lambda x: x.cast("string")), ","))
    return df


def sessions_cte(gap: int, rows: str = "v_visits") -> str:
    return f"""
      v_marked AS (SELECT sid, day, us, path, event_name,
          CASE WHEN us - lag(us) OVER (PARTITION BY sid, day ORDER BY us) <= {gap}000000 THEN 0 ELSE 1 END AS fresh
        FROM {rows}),
      v_numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY sid, day ORDER BY us) AS session_no FROM v_marked),
      v_sessions AS (SELECT sid, day, session_no, min(us) AS start_us, max(us) AS last_us, count(*) AS visits,
          count(CASE WHEN path = '/recommend' THEN 1 END) AS recommends,
          max(list_position({STAGES_SQL}, event_name)) - 1 AS stage
        FROM v_numbered GROUP BY ALL)"""


METRICS_SQL = """
    SELECT CAST(day AS VARCHAR) AS {d}, count(*) AS sessions,
           CAST(sum((last_us - start_us) // 1000000) AS BIGINT) AS total_duration_seconds,
           count(CASE WHEN recommends < 2 THEN 1 END) AS bounces,
           round(sum((last_us - start_us) // 1000000) / count(*), 1) AS avg_duration_seconds,
           round(100.0 * count(CASE WHEN recommends < 2 THEN 1 END) / count(*), 1) AS bounce_rate_pct
    FROM v_sessions GROUP BY day"""


@query("daily_active", with_views(["v_visits"], """
    SELECT CAST(day AS VARCHAR) AS day, count(DISTINCT ip) AS "count" FROM v_visits GROUP BY 1"""))
def daily_active(spark, sf_dir):
    return day_text(A.daily_active(S.visits(spark, sf_dir)))


@query("daily_active_sketch")
def daily_active_sketch(spark, sf_dir):
    s = A.active_sketch(S.visits(spark, sf_dir))
    month = s.groupBy(F.date_format("day", "yyyy-MM").alias("month")).agg(
        F.hll_union_agg("visitors").alias("u"))
    return month.select("month", F.hll_sketch_estimate("u").alias("visitors"))


def pad_sql(key: str, byte: int) -> str:
    """The key of an HMAC, at most 64 ASCII characters, padded with zeros and met with one byte."""
    return (f"unhex(array_to_string(list_transform(string_split({key}, ''), lambda x: printf('%02x', xor(ord(x), {byte}))), '') "
            f"|| repeat('{byte:02x}', 64 - length({key})))")


def hmac_sql(key: str, message: str) -> str:
    return f"sha256({pad_sql(key, 0x5C)} || unhex(sha256({pad_sql(key, 0x36)} || encode({message}))))"


@query("visitor_keys", with_views(["v_visits"], f"""
    SELECT CAST(day AS VARCHAR) AS day, {hmac_sql("'salt' || CAST(day AS VARCHAR)", 'ip')} AS day_key, {hmac_sql("'stable-key'", 'ip')} AS stable_key
    FROM (SELECT DISTINCT day, ip // 16777216 || '.' || ip // 65536 % 256 || '.' || ip // 256 % 256 || '.' || ip % 256 AS ip FROM v_visits)"""))
def visitor_keys(spark, sf_dir):
    """Day-salted and stable keyed hashes that stand for addresses."""
    v = S.visits(spark, sf_dir).select(local_date(F.col("ts")).alias("day"), "ip").distinct()
    return day_text(v.select("day", hmac_sha256(daily_key("salt", F.col("day")), F.col("ip")).alias("day_key"),
                             hmac_sha256(b"stable-key", F.col("ip")).alias("stable_key")))


@query("hourly_histogram", with_views(["v_visits"], """
    SELECT CAST(day AS VARCHAR) AS day, string_agg(CAST(n AS VARCHAR), ',' ORDER BY h) AS hours,
           CAST(arg_max(h, n * 100 - h) AS INTEGER) AS peak_hour
    FROM (SELECT d.day, hh.h, count(v.visit_id) AS n
          FROM (SELECT DISTINCT day FROM v_visits WHERE path = '/recommend') d
          CROSS JOIN (SELECT unnest(range(24)) AS h) hh
          LEFT JOIN v_visits v ON v.day = d.day AND hour(v.lts) = hh.h AND v.path = '/recommend'
          GROUP BY ALL) GROUP BY day"""))
def hourly_histogram(spark, sf_dir):
    return array_text(day_text(A.hourly_histogram(S.visits(spark, sf_dir))), "hours")


@query("device_mix", with_views(["v_visits"], """
    SELECT CAST(day AS VARCHAR) AS day, count(CASE WHEN ua IN (0, 5) THEN 1 END) AS mobile, count(CASE WHEN ua = 2 THEN 1 END) AS tablet,
           count(CASE WHEN ua = 1 THEN 1 END) AS desktop, count(CASE WHEN ua = 3 THEN 1 END) AS bot, count(CASE WHEN ua = 4 THEN 1 END) AS unknown
    FROM v_visits WHERE path = '/ping' GROUP BY 1"""))
def device_mix(spark, sf_dir):
    return day_text(A.device_mix(S.visits(spark, sf_dir))).select("day", *DEVICE_BUCKETS)


OWN = ["spam-farm.example.org"]


@query("referrer_mix", with_views(["v_referers"], """
    SELECT CAST(day AS VARCHAR) AS day, count(CASE WHEN host IS NULL OR host = 'spam-farm.example.org' THEN 1 END) AS direct,
           count(CASE WHEN host IN ('google.com','bing.com','duckduckgo.com') OR host LIKE '%.google.com'
                    OR host LIKE '%.bing.com' THEN 1 END) AS search,
           count(CASE WHEN host IN ('facebook.com','x.com','t.co','reddit.com') THEN 1 END) AS social,
           count(CASE WHEN NOT (host IS NULL OR host = 'spam-farm.example.org'
                    OR host IN ('google.com','bing.com','duckduckgo.com','facebook.com','x.com','t.co','reddit.com')
                    OR host LIKE '%.google.com' OR host LIKE '%.bing.com') THEN 1 END) AS other
    FROM v_referers GROUP BY 1"""))
def referrer_mix(spark, sf_dir):
    return day_text(A.referrer_mix(S.referers(spark, sf_dir), OWN))


@query("referrer_hosts", with_views(["v_referers"], """
    SELECT CAST(day AS VARCHAR) AS day, host, count(*) AS n FROM v_referers
    WHERE host IS NOT NULL AND host <> 'spam-farm.example.org' GROUP BY ALL"""))
def referrer_hosts(spark, sf_dir):
    return day_text(A.referrer_hosts(S.referers(spark, sf_dir), OWN))


@query("top_referrer_hosts", with_views(["v_referers"], """
    SELECT host, count(*) AS n FROM v_referers WHERE host IS NOT NULL AND host <> 'spam-farm.example.org'
    GROUP BY host ORDER BY n DESC, host LIMIT 10"""))
def top_referrer_hosts(spark, sf_dir):
    return A.top_referrer_hosts(A.referrer_hosts(S.referers(spark, sf_dir), OWN))


def by_city(spark, sf_dir):
    return A.ip_to_city(S.visits(spark, sf_dir), S.networks(spark, sf_dir))


@query("ip_to_city", with_views(["v_by_city"],
       "SELECT CAST(day AS VARCHAR) AS day, city, n FROM v_by_city"))
def ip_to_city(spark, sf_dir):
    return day_text(by_city(spark, sf_dir))


@query("ip_to_city_both_families", with_views(["v_visits", "v_networks"], """
    SELECT CAST(v.day AS VARCHAR) AS day, CASE WHEN v.sid::BIGINT % 3 <> 0 THEN n.city
      WHEN v.sid::BIGINT % 4096 % 128 < 2 THEN m.n_name || ' inner' ELSE m.n_name END AS city, count(*) AS n
    FROM v_visits v LEFT JOIN v_networks n ON v.sid::BIGINT % 3 <> 0 AND v.ip BETWEEN n.start_ip AND n.end_ip
      LEFT JOIN nation m ON v.sid::BIGINT % 3 = 0 AND v.sid::BIGINT % 4096 // 128 = m.n_nationkey AND v.sid::BIGINT % 4096 % 128 < 64
    WHERE n.city IS NOT NULL OR m.n_name IS NOT NULL GROUP BY ALL"""))
def ip_to_city_both_families(spark, sf_dir):
    return day_text(A.ip_to_city(S.visits_both_families(spark, sf_dir), S.networks(spark, sf_dir), S.networks_six(spark, sf_dir)))


@query("city_counts", with_views(["v_by_city"], """
    SELECT CAST(day AS VARCHAR) AS day, CASE WHEN n < 5 THEN 'Other' ELSE city END AS city,
           CAST(sum(n) AS BIGINT) AS n FROM v_by_city GROUP BY 1, 2"""))
def city_counts(spark, sf_dir):
    return day_text(A.city_counts(by_city(spark, sf_dir)))


METRO_SQL = with_views(["v_by_city"], """
    SELECT CAST(day AS VARCHAR) AS {d},
           CAST(coalesce(sum(n) FILTER (lower(city) IN ('nation_1','nation_7','nation_12','nation_20')), 0) AS BIGINT) AS metro,
           CAST(sum(n) AS BIGINT) AS total,
           round(100.0 * coalesce(sum(n) FILTER (lower(city) IN ('nation_1','nation_7','nation_12','nation_20')), 0) / sum(n), 1) AS share_pct
    FROM v_by_city GROUP BY 1""")


@query("metro_share", METRO_SQL.format(d="day"))
def metro_share(spark, sf_dir):
    return day_text(A.metro_share(by_city(spark, sf_dir), METRO))


EVENT_SQL = ", ".join(f"count(CASE WHEN event_name = '{n}' THEN 1 END) AS {n}" for n in A.ALLOWED_EVENTS)
ANSWERED = """CASE WHEN count(CASE WHEN event_name = 'recommend_submitted' THEN 1 END) = 0 THEN 0.0 ELSE
    round(100.0 * count(CASE WHEN event_name = 'recommend_returned' THEN 1 END) / count(CASE WHEN event_name = 'recommend_submitted' THEN 1 END), 1) END"""
NAMES_SQL = "'app_loaded','recommend_submitted','recommend_returned','trip_completed'"


@query("event_counts", with_views(["v_visits"], f"""
    SELECT CAST(day AS VARCHAR) AS day, {EVENT_SQL}, {ANSWERED} AS answered_pct
    FROM v_visits WHERE event_name IN ({NAMES_SQL}) GROUP BY 1"""))
def event_counts(spark, sf_dir):
    return day_text(A.event_counts(S.visits(spark, sf_dir)))


@query("allowed_events", with_views(["v_visits"], f"""
    SELECT event_name, count(*) AS n, min(visit_id) AS first_id FROM v_visits
    WHERE event_name IN ({NAMES_SQL}) GROUP BY 1"""))
def allowed_events(spark, sf_dir):
    return A.allowed_events(S.visits(spark, sf_dir)).groupBy("event_name").agg(
        F.count("*").alias("n"), F.min("visit_id").alias("first_id"))


@query("rejected_events", with_views(["v_visits"], f"""
    SELECT event_name, count(*) AS n FROM v_visits WHERE event_name NOT IN ({NAMES_SQL}) GROUP BY 1"""))
def rejected_events(spark, sf_dir):
    return A.rejected_events(S.visits(spark, sf_dir))


def _session_queries(tag: str, gap: int) -> None:
    cte = sessions_cte(gap)

    @query(f"sessionize_{tag}", with_views(["v_visits"], """
        SELECT sid, CAST(day AS VARCHAR) AS day, CAST(session_no AS BIGINT) AS session_no, start_us, last_us,
               visits, recommends FROM v_sessions""", cte))
    def _sessions(spark, sf_dir):
        return day_text(A.sessionize(S.visits(spark, sf_dir), gap))

    @query(f"session_metrics_{tag}", with_views(["v_visits"], METRICS_SQL.format(d="day"), cte))
    def _metrics(spark, sf_dir):
        return day_text(A.session_metrics(A.sessionize(S.visits(spark, sf_dir), gap)))

    @query(f"funnel_{tag}", with_views(["v_visits"], """
        SELECT CAST(day AS VARCHAR) AS day,
               concat_ws(',', count(CASE WHEN stage >= 0 THEN 1 END), count(CASE WHEN stage >= 1 THEN 1 END), count(CASE WHEN stage >= 2 THEN 1 END),
                         count(CASE WHEN stage >= 3 THEN 1 END), count(CASE WHEN stage >= 4 THEN 1 END), count(CASE WHEN stage >= 5 THEN 1 END)) AS counts,
               CASE WHEN count(CASE WHEN stage >= 0 THEN 1 END) = 0 THEN 0.0
                    ELSE round(100.0 * count(CASE WHEN stage >= 2 THEN 1 END) / count(CASE WHEN stage >= 0 THEN 1 END), 1) END AS result_rate_pct
        FROM v_sessions WHERE stage >= 0 GROUP BY 1""", cte))
    def _funnel(spark, sf_dir):
        v = S.visits(spark, sf_dir)
        return array_text(day_text(A.funnel(A.session_stages(v, v, gap_seconds=gap))), "counts")


_session_queries("30min", 1800)
_session_queries("6h", 21600)

RETENTION_SQL = with_views(["v_visits"], """
    SELECT CAST(day AS VARCHAR) AS {d}, count(CASE WHEN day = first_day THEN 1 END) AS "new", count(CASE WHEN day > first_day THEN 1 END) AS returning,
           count(*) AS total, round(100.0 * count(CASE WHEN day > first_day THEN 1 END) / count(*), 1) AS returning_pct
    FROM (SELECT sid, day, min(day) OVER (PARTITION BY sid) AS first_day
          FROM (SELECT DISTINCT sid, day FROM v_visits WHERE path = '/ping')) GROUP BY 1""")


@query("new_vs_returning", RETENTION_SQL.format(d="day"))
def new_vs_returning(spark, sf_dir):
    return day_text(A.new_vs_returning(S.visits(spark, sf_dir)))


@query("returning_sketched", RETENTION_SQL.format(d="day"))
def returning_sketched(spark, sf_dir):
    return day_text(A.returning_sketched(A.visitor_sketches(S.visits(spark, sf_dir))))


@query("returning_by_week", with_views(["v_visits"], """
    SELECT CAST(week AS VARCHAR) AS day, count(*) FILTER (week = first) AS "new", count(*) FILTER (week > first) AS returning
    FROM (SELECT DISTINCT rid, week, min(week) OVER (PARTITION BY rid) AS first
          FROM (SELECT sid AS rid, CAST(date_trunc('week', day) AS DATE) AS week FROM v_visits WHERE path = '/ping')) GROUP BY 1"""))
def returning_by_week(spark, sf_dir):
    weeks = A.roll_up(A.visitor_sketches(S.visits(spark, sf_dir)), "week")
    return day_text(A.returning_sketched(weeks)).select("day", "new", "returning")


@query("call_budget", """
    SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS calls,
           greatest(300 - count(*), 0) AS remaining, count(*) > 300 AS over_cap
    FROM events GROUP BY 1""")
def call_budget(spark, sf_dir):
    return day_text(A.call_budget(S.visits(spark, sf_dir), cap=300))


@query("rate_demand", with_views(["v_visits"], """
    SELECT visit_id, count(*) OVER (w RANGE BETWEEN 60000000 PRECEDING AND CURRENT ROW) AS last_minute,
           count(*) OVER (w RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW) AS last_hour,
           count(*) OVER (w RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW) AS last_day
    FROM v_visits WINDOW w AS (PARTITION BY ip ORDER BY us)"""))
def rate_demand(spark, sf_dir):
    return A.rate_demand(S.visits(spark, sf_dir)).drop("ip")


# --- public panels ------------------------------------------------------------


def panel(spark, sf_dir, daily: DataFrame, name: str) -> DataFrame:
    return day_text(P.public_panel(daily, name), "date")


@query("panel_dau", with_views(["v_visits"], """
    SELECT CAST(day AS VARCHAR) AS date, count(DISTINCT ip) AS "count" FROM v_visits GROUP BY 1"""))
def panel_dau(spark, sf_dir):
    return panel(spark, sf_dir, A.daily_active(S.visits(spark, sf_dir)), "dau")


@query("panel_geography", METRO_SQL.format(d="date"))
def panel_geography(spark, sf_dir):
    return panel(spark, sf_dir, A.metro_share(by_city(spark, sf_dir), METRO), "geography")


@query("panel_sessions", with_views(["v_visits"], """
    SELECT CAST(day AS VARCHAR) AS date, count(*) AS sessions,
           round(sum((last_us - start_us) // 1000000) / count(*), 1) AS avg_duration_seconds,
           round(100.0 * count(CASE WHEN recommends < 2 THEN 1 END) / count(*), 1) AS bounce_rate_pct
    FROM v_sessions GROUP BY day""", sessions_cte(1800)))
def panel_sessions(spark, sf_dir):
    return panel(spark, sf_dir, A.session_metrics(A.sessionize(S.visits(spark, sf_dir))), "sessions")


@query("panel_hourly", with_views(["v_visits"], """
    SELECT CAST(day AS VARCHAR) AS date, string_agg(CAST(n AS VARCHAR), ',' ORDER BY h) AS hours,
           CAST(sum(n) AS BIGINT) AS total
    FROM (SELECT d.day, hh.h, count(v.visit_id) AS n
          FROM (SELECT DISTINCT day FROM v_visits WHERE path = '/recommend') d
          CROSS JOIN (SELECT unnest(range(24)) AS h) hh
          LEFT JOIN v_visits v ON v.day = d.day AND hour(v.lts) = hh.h AND v.path = '/recommend'
          GROUP BY ALL) GROUP BY day"""))
def panel_hourly(spark, sf_dir):
    return array_text(panel(spark, sf_dir, A.hourly_histogram(S.visits(spark, sf_dir)), "hourly"), "hours")


@query("panel_devices", with_views(["v_visits"], """
    SELECT CAST(day AS VARCHAR) AS date, count(CASE WHEN ua IN (0, 5) THEN 1 END) AS mobile, count(CASE WHEN ua = 2 THEN 1 END) AS tablet,
           count(CASE WHEN ua = 1 THEN 1 END) AS desktop, count(CASE WHEN ua IN (0, 1, 2, 5) THEN 1 END) AS total
    FROM v_visits WHERE path = '/ping' GROUP BY 1"""))
def panel_devices(spark, sf_dir):
    return panel(spark, sf_dir, A.device_mix(S.visits(spark, sf_dir)), "devices")


@query("panel_referrers", with_views(["v_referers"], """
    SELECT CAST(day AS VARCHAR) AS date, count(CASE WHEN host IS NULL OR host = 'spam-farm.example.org' THEN 1 END) AS direct,
           count(CASE WHEN host LIKE '%.google.com' OR host IN ('google.com','bing.com') THEN 1 END) AS search,
           count(CASE WHEN host IN ('facebook.com','x.com','t.co','reddit.com') THEN 1 END) AS social,
           count(CASE WHEN NOT (host IS NULL OR host = 'spam-farm.example.org' OR host LIKE '%.google.com' OR host IN
             ('google.com','bing.com','facebook.com','x.com','t.co','reddit.com')) THEN 1 END) AS other, count(*) AS total
    FROM v_referers GROUP BY 1"""))
def panel_referrers(spark, sf_dir):
    return panel(spark, sf_dir, A.referrer_mix(S.referers(spark, sf_dir), OWN), "referrers")


@query("panel_events", with_views(["v_visits"], f"""
    SELECT CAST(day AS VARCHAR) AS date, count(CASE WHEN event_name = 'recommend_submitted' THEN 1 END) AS recommend_submitted,
           count(CASE WHEN event_name = 'recommend_returned' THEN 1 END) AS recommend_returned, CAST(0 AS BIGINT) AS route_selected,
           count(CASE WHEN event_name = 'trip_completed' THEN 1 END) AS trip_completed,
           count(CASE WHEN event_name IN ('recommend_submitted','recommend_returned','trip_completed') THEN 1 END) AS total
    FROM v_visits WHERE event_name IN ({NAMES_SQL}) GROUP BY 1"""))
def panel_events(spark, sf_dir):
    return panel(spark, sf_dir, A.event_counts(S.visits(spark, sf_dir)), "events")


@query("panel_funnel", with_views(["v_visits"], """
    SELECT CAST(day AS VARCHAR) AS date,
           'app_loaded,recommend_submitted,recommend_returned,route_selected,start_route_tapped,trip_completed' AS stages,
           concat_ws(',', count(CASE WHEN stage >= 0 THEN 1 END), count(CASE WHEN stage >= 1 THEN 1 END), count(CASE WHEN stage >= 2 THEN 1 END),
                     count(CASE WHEN stage >= 3 THEN 1 END), count(CASE WHEN stage >= 4 THEN 1 END), count(CASE WHEN stage >= 5 THEN 1 END)) AS counts,
           round(100.0 * count(CASE WHEN stage >= 2 THEN 1 END) / count(CASE WHEN stage >= 0 THEN 1 END), 1) AS result_rate_pct
    FROM v_sessions WHERE stage >= 0 GROUP BY 1""", sessions_cte(1800)))
def panel_funnel(spark, sf_dir):
    v = S.visits(spark, sf_dir)
    return array_text(panel(spark, sf_dir, A.funnel(A.session_stages(v, v)), "funnel"), "counts", "stages")


@query("panel_retention", RETENTION_SQL.format(d="date"))
def panel_retention(spark, sf_dir):
    return panel(spark, sf_dir, A.new_vs_returning(S.visits(spark, sf_dir)), "retention")


@query("recent_days_dau", with_views(["v_visits"], """
    SELECT CAST(day AS VARCHAR) AS date, count(DISTINCT ip) AS "count" FROM v_visits GROUP BY 1
    ORDER BY 1 DESC LIMIT 7"""))
def recent_days_dau(spark, sf_dir):
    d = P.recent_days(P.public_panel(A.daily_active(S.visits(spark, sf_dir)), "dau"), 7)
    return day_text(d, "date")


@query("latest_day_dau", with_views(["v_visits"], """
    SELECT CAST(day AS VARCHAR) AS date, count(DISTINCT ip) AS "count" FROM v_visits GROUP BY 1
    ORDER BY 1 DESC LIMIT 1"""))
def latest_day_dau(spark, sf_dir):
    return day_text(P.latest_day(P.public_panel(A.daily_active(S.visits(spark, sf_dir)), "dau")), "date")
