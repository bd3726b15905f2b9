"""Daily product analytics over the visit log.

All counters combine before the shuffle. Sessions are built from per-bucket
minima and maxima, never from the raw rows of one visitor, so a single visitor
with any share of the traffic costs one small group.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import web
from ..functions.timecode import LOCAL_TZ, epoch_us, local_date, local_ts
from ..functions.web import (
    DEVICE_BUCKETS,
    device_bucket,
    referrer_bucket,
    url_host,
)

# Event allow-list, funnel order, privacy floor, bounce limit,
# idle timeout, paths that count.
ALLOWED_EVENTS = [
    "app_loaded", "recommend_submitted", "recommend_returned", "route_selected",
    "start_route_tapped", "map_opened", "house_ad_clicked", "trip_completed",
    "trip_off_route", "trip_rerouted", "off_route_dismissed", "install_prompt_shown",
    "install_prompt_accepted", "install_prompt_dismissed", "install_completed",
]
FUNNEL_STAGES = [
    "app_loaded", "recommend_submitted", "recommend_returned",
    "route_selected", "start_route_tapped", "trip_completed",
]
CITY_FLOOR = 5
BOUNCE_BELOW = 2
IDLE_SECONDS = 1800
VISIT_PATHS = ["/ping", "/recommend"]
DAILY_CALL_CAP = 4900
#: Binary logarithm of the entries of a visitor sketch.
SKETCH_ENTRIES = 14


def eligible(visits: DataFrame) -> DataFrame:
    return visits.where(F.col("path").isin(VISIT_PATHS))


def pct(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, 0.0).otherwise(F.round(part * F.lit(100.0) / whole, 1))


def daily_active(visits: DataFrame) -> DataFrame:
    """Distinct addresses per local day; deduplicated before the shuffle."""
    return (
        eligible(visits)
        .select(local_date(F.col("ts")).alias("day"), "ip")
        .distinct()
        .groupBy("day").agg(F.count("*").alias("count"))
    )


def active_sketch(visits: DataFrame) -> DataFrame:
    """Mergeable form: one sketch per day, to be united over any span of days."""
    return (
        eligible(visits)
        .groupBy(local_date(F.col("ts")).alias("day"))
        .agg(F.hll_sketch_agg("ip").alias("visitors"))
    )


def hourly_histogram(visits: DataFrame) -> DataFrame:
    """24 counts of `/recommend` per local day and the first busiest hour."""
    lt = local_ts(F.col("ts"))
    h = visits.where(F.col("path") == "/recommend").select(
        lt.cast("date").alias("day"), F.hour(lt).alias("h")
    )
    slots = [F.count_if(F.col("h") == i) for i in range(24)]
    return h.groupBy("day").agg(F.array(*slots).alias("hours")).withColumn(
        "peak_hour", F.array_position("hours", F.array_max("hours")).cast("int") - 1
    )


def device_mix(visits: DataFrame) -> DataFrame:
    """Visits per device bucket, page loads only."""
    b = visits.where(F.col("path") == "/ping").select(
        local_date(F.col("ts")).alias("day"), device_bucket(F.col("user_agent")).alias("b")
    )
    return b.groupBy("day").agg(
        *[F.count_if(F.col("b") == x).alias(x) for x in DEVICE_BUCKETS]
    )


def referrer_visits(visits: DataFrame, own_hosts: list[str] | None = None) -> DataFrame:
    """(day, bucket, host) of every visit that carries a `day` and a `referer`."""
    host = url_host(F.col("referer"))
    return visits.select("day", host.alias("host")).withColumn(
        "bucket", referrer_bucket(F.col("host"), own_hosts)
    )


def referrer_mix(visits: DataFrame, own_hosts: list[str] | None = None) -> DataFrame:
    b = referrer_visits(visits, own_hosts)
    names = ["direct", "search", "social", "other"]
    return b.groupBy("day").agg(*[F.count_if(F.col("bucket") == n).alias(n) for n in names])


def referrer_hosts(visits: DataFrame, own_hosts: list[str] | None = None) -> DataFrame:
    """The long tail: visits per day and host outside the known buckets."""
    return (
        referrer_visits(visits, own_hosts).where(F.col("bucket") == "other")
        .groupBy("day", "host").agg(F.count("*").alias("n"))
    )


def top_referrer_hosts(hosts: DataFrame, k: int = 10) -> DataFrame:
    """The k busiest hosts over all days."""
    return (
        hosts.groupBy("host").agg(F.sum("n").alias("n"))
        .orderBy(F.desc("n"), "host").limit(k)
    )


def network_prefixes(networks: DataFrame) -> DataFrame:
    """(bits, prefix, width, start, city) of networks given as `network` in CIDR form, of either family,
    or as IPv4 numbers `start_ip` to `end_ip`.

    A range falls into the aligned blocks it is made of, two of each size at
    most; each keeps the width of its range.
    """
    if "network" in networks.columns:
        text = F.split("network", "/")
        n = networks.select("city", web.address_hex(F.get(text, F.lit(0))).alias("start"), F.get(text, F.lit(0)).contains(":").alias("six"),
                            F.get(text, F.lit(1)).try_cast("int").alias("said"))
        most = F.when(F.col("six"), 128).otherwise(32)
        n = n.withColumn("said", F.coalesce("said", most)).where(F.col("said").between(0, most) & F.col("start").isNotNull())
        n = n.withColumn("bits", F.col("said") + 128 - most)
        return n.select("bits", web.prefix_hex(F.col("start"), F.col("bits")).alias("prefix"),
                        F.pow(F.lit(2.0), 128 - F.col("bits")).alias("width"), "start", "city")

    def block(level: Column) -> Column:
        size = F.pow(F.lit(2), level).cast("bigint")
        low, high = F.ceil(F.col("start_ip") / size), F.floor((F.col("end_ip") + 1) / size)
        took = F.filter(F.array(F.when(low % 2 == 1, low), F.when(high % 2 == 1, high - 1)), lambda x: x.isNotNull())
        return F.transform(F.when(low < high, F.array_distinct(took)).otherwise(F.array().cast("array<bigint>")),
                           lambda x: F.struct((128 - level).alias("bits"), (x * size).alias("at")))

    blocks = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(32)), block))
    n = networks.select("city", "start_ip", (F.col("end_ip") - F.col("start_ip") + 1).cast("double").alias("width"), F.inline(blocks))
    mapped = lambda c: F.concat(F.lit(web.IPV4_PREFIX), F.lpad(F.lower(F.hex(c)), 8, "0"))
    return n.select("bits", web.prefix_hex(mapped(F.col("at")), F.col("bits")).alias("prefix"), "width",
                    mapped(F.col("start_ip")).alias("start"), "city")


def ip_to_city(visits: DataFrame, *networks: DataFrame) -> DataFrame:
    """Visits per (day, city) by the narrowest network that holds the address; others are dropped.

    Addresses of both families are 128 bits. Visits shrink to one row per (day,
    address) first; each distinct address is looked up once, by equi-joins on
    the prefix lengths that occur. Of equally narrow networks the first counts.
    """
    v = eligible(visits).groupBy(local_date(F.col("ts")).alias("day"), "ip").agg(F.count("*").alias("n"))
    nets = reduce(DataFrame.unionByName, map(network_prefixes, networks))
    lengths = sorted(r.bits for r in nets.select("bits").distinct().collect())      # at most 129 numbers
    asked = v.select("ip").distinct().withColumn("address", web.address_hex(F.col("ip"))).where("address is not null")
    asked = asked.withColumn("bits", F.explode(F.array(*map(F.lit, lengths)).cast("array<int>")))
    asked = asked.select("ip", "bits", web.prefix_hex(F.col("address"), F.col("bits")).alias("prefix"))
    found = asked.join(nets, ["bits", "prefix"]).groupBy("ip").agg(F.min_by("city", F.struct("width", "start", "city")).alias("city"))
    return v.join(found, "ip").groupBy("day", "city").agg(F.sum("n").alias("n"))


def city_counts(by_city: DataFrame, floor: int = CITY_FLOOR) -> DataFrame:
    """Cities below the floor on a day fold into `Other`."""
    shown = F.when(F.col("n") < floor, "Other").otherwise(F.col("city"))
    return by_city.groupBy("day", shown.alias("city")).agg(F.sum("n").alias("n"))


def metro_share(by_city: DataFrame, metro: list[str]) -> DataFrame:
    """Share of the metro cities, from the counts before the floor."""
    inside = F.lower("city").isin([m.lower() for m in metro])
    return (
        by_city.groupBy("day")
        .agg(F.coalesce(F.sum(F.when(inside, F.col("n"))), F.lit(0)).alias("metro"),
             F.sum("n").alias("total"))
        .withColumn("share_pct", pct(F.col("metro"), F.col("total")))
    )


def allowed_events(events: DataFrame) -> DataFrame:
    return events.where(F.col("event_name").isin(ALLOWED_EVENTS))


def rejected_events(events: DataFrame) -> DataFrame:
    bad = events.where(~F.col("event_name").isin(ALLOWED_EVENTS) | F.col("event_name").isNull())
    return bad.groupBy("event_name").agg(F.count("*").alias("n"))


def event_counts(events: DataFrame) -> DataFrame:
    """Per local day, one column per allowed name, and the share of searches answered."""
    day = local_date(F.col("ts")).alias("day")
    counts = [F.count_if(F.col("event_name") == n).alias(n) for n in ALLOWED_EVENTS]
    return (
        allowed_events(events).groupBy(day).agg(*counts)
        .withColumn("answered_pct", pct(F.col("recommend_returned"), F.col("recommend_submitted")))
    )


# --- sessions ---------------------------------------------------------------


def visit_buckets(visits: DataFrame, gap_seconds: int = IDLE_SECONDS,
                  tz: str = LOCAL_TZ) -> DataFrame:
    """First and last visit per (sid, local day, gap-wide time bucket).

    Two visits in one bucket are less than the gap apart, hence in one session:
    sessions are unions of whole buckets and only bucket rows need ordering.
    """
    us = epoch_us(F.col("ts"))
    return (
        eligible(visits)
        .select("sid", local_date(F.col("ts"), tz).alias("day"), us.alias("us"),
                (F.col("path") == "/recommend").alias("rec"))
        .withColumn("bucket", F.floor(F.col("us") / (gap_seconds * 1_000_000)))
        .groupBy("sid", "day", "bucket")
        .agg(F.min("us").alias("first_us"), F.max("us").alias("last_us"),
             F.count("*").alias("visits"), F.count_if("rec").alias("recommends"))
    )


def number_sessions(buckets: DataFrame, gap_seconds: int = IDLE_SECONDS) -> DataFrame:
    """Running session number per (sid, day); a new one after more than the gap."""
    w = Window.partitionBy("sid", "day").orderBy("bucket")
    pause = F.col("first_us") - F.lag("last_us").over(w)
    fresh = F.coalesce((pause > gap_seconds * 1_000_000).cast("int"), F.lit(1))
    return buckets.withColumn("_new", fresh).withColumn(
        "session_no", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))
    ).drop("_new")


def sessionize(visits: DataFrame, gap_seconds: int = IDLE_SECONDS) -> DataFrame:
    """One row per session: start, last visit, visits, recommends."""
    return (
        number_sessions(visit_buckets(visits, gap_seconds), gap_seconds)
        .groupBy("sid", "day", "session_no")
        .agg(F.min("first_us").alias("start_us"), F.max("last_us").alias("last_us"),
             F.sum("visits").alias("visits"), F.sum("recommends").alias("recommends"))
    )


def session_metrics(sessions: DataFrame) -> DataFrame:
    """Per start day: sessions, seconds, bounces and their ratios."""
    secs = F.floor((F.col("last_us") - F.col("start_us")) / 1_000_000)
    return (
        sessions.groupBy("day")
        .agg(F.count("*").alias("sessions"), F.sum(secs).alias("total_duration_seconds"),
             F.count_if(F.col("recommends") < BOUNCE_BELOW).alias("bounces"))
        .withColumn("avg_duration_seconds",
                    F.round(F.col("total_duration_seconds") / F.col("sessions"), 1))
        .withColumn("bounce_rate_pct", pct(F.col("bounces"), F.col("sessions")))
    )


def session_stages(visits: DataFrame, events: DataFrame, stages: list[str] | None = None,
                   gap_seconds: int = IDLE_SECONDS) -> DataFrame:
    """Highest funnel stage of every session (-1 when none was reached).

    An event counts when a visit of the same day lies at most one gap before
    it. With gap-wide buckets that visit is in the event's bucket or the one
    before, so the earliest and latest event per (bucket, stage) decide.
    """
    stages = stages or FUNNEL_STAGES
    idx = F.array_position(F.array(*[F.lit(s) for s in stages]), F.col("event_name")) - 1
    gap_us = gap_seconds * 1_000_000
    ev = (
        events.select("sid", local_date(F.col("ts")).alias("day"),
                      epoch_us(F.col("ts")).alias("us"), idx.cast("int").alias("stage"))
        .where(F.col("stage") >= 0)
        .withColumn("bucket", F.floor(F.col("us") / gap_us))
        .groupBy("sid", "day", "bucket", "stage")
        .agg(F.min("us").alias("e_first"), F.max("us").alias("e_last"))
    )
    ses = number_sessions(visit_buckets(visits, gap_seconds), gap_seconds)
    here = ses.select("sid", "day", "bucket", "session_no", "first_us")
    before = ses.select("sid", "day", (F.col("bucket") + 1).alias("bucket"),
                        F.col("session_no").alias("prev_no"), F.col("last_us").alias("prev_last"))
    keys = ["sid", "day", "bucket"]
    j = ev.join(here, keys, "left").join(before, keys, "left")
    in_here = F.col("e_last") >= F.col("first_us")
    in_prev = (F.col("e_first") <= F.col("prev_last") + gap_us) & (
        F.col("first_us").isNull() | (F.col("e_first") < F.col("first_us"))
    )
    hits = j.select(
        "sid", "day", "stage",
        F.explode(F.array_compact(F.array(
            F.when(in_here, F.col("session_no")), F.when(in_prev, F.col("prev_no"))
        ))).alias("session_no"),
    )
    base = ses.select("sid", "day", "session_no", F.lit(-1).alias("stage"))
    return (
        base.unionByName(hits.select("sid", "day", "session_no", "stage"))
        .groupBy("sid", "day", "session_no").agg(F.max("stage").alias("stage"))
    )


def funnel(stages_by_session: DataFrame, n: int = len(FUNNEL_STAGES)) -> DataFrame:
    """Per day the sessions that reached at least stage 0..n-1, and n2 / n0."""
    top = F.least(F.col("stage"), F.lit(n - 1))
    reached = stages_by_session.where(F.col("stage") >= 0).withColumn("stage", top)
    counts = [F.count_if(F.col("stage") >= i) for i in range(n)]
    out = reached.groupBy("day").agg(F.array(*counts).alias("counts"))
    return out.withColumn("result_rate_pct", pct(F.col("counts")[2], F.col("counts")[0]))


def new_vs_returning(visits: DataFrame) -> DataFrame:
    """Each visitor once per day; returning when seen on an earlier day."""
    days = (
        visits.where(F.col("path") == "/ping")
        .select("rid", local_date(F.col("ts")).alias("day")).distinct()
    )
    first = F.min("day").over(Window.partitionBy("rid"))
    return (
        days.withColumn("first_day", first).groupBy("day")
        .agg(F.count_if(F.col("day") == F.col("first_day")).alias("new"),
             F.count_if(F.col("day") > F.col("first_day")).alias("returning"))
        .withColumn("total", F.col("new") + F.col("returning"))
        .withColumn("returning_pct", pct(F.col("returning"), F.col("total")))
    )


def visitor_sketches(visits: DataFrame, lg_entries: int = SKETCH_ENTRIES) -> DataFrame:
    """(day, visitors): one theta sketch of the day's visitors. Sketches merge, so raw rows may go."""
    days = visits.where((F.col("path") == "/ping") & F.col("rid").isNotNull()).select("rid", local_date(F.col("ts")).alias("day"))
    return days.groupBy("day").agg(F.theta_sketch_agg("rid", lg_entries).alias("visitors"))


def roll_up(sketches: DataFrame, span: str) -> DataFrame:
    """Day sketches merged by calendar span (`week`, `month`, …), named by its first day."""
    return sketches.groupBy(F.trunc("day", span).alias("day")).agg(F.theta_union_agg("visitors", SKETCH_ENTRIES).alias("visitors"))


def returning_sketched(sketches: DataFrame) -> DataFrame:
    """As `new_vs_returning`, from sketches of days or longer spans: met with, or less, the union of all spans before.

    Exact while all visitors fit into one sketch, 2 ** 14 by default; beyond it
    counts are estimates, off by about 1 / sqrt(2 ** 14) = 0.8 % of all visitors
    up to that span in one of three. The table has one row per span.
    """
    before = F.theta_union_agg("visitors", SKETCH_ENTRIES).over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1))
    s = sketches.withColumn("before", before)
    count = lambda c: F.round(F.theta_sketch_estimate(c)).cast("long")
    known = F.col("before").isNotNull()
    s = s.select("day", F.when(known, count(F.theta_difference("visitors", "before"))).otherwise(count(F.col("visitors"))).alias("new"),
                 F.when(known, count(F.theta_intersection("visitors", "before"))).otherwise(0).alias("returning"))
    return s.withColumn("total", F.col("new") + F.col("returning")).withColumn("returning_pct", pct(F.col("returning"), F.col("total")))


def call_budget(calls: DataFrame, cap: int = DAILY_CALL_CAP) -> DataFrame:
    """Calls per UTC day against the cap."""
    return (
        calls.groupBy(F.col("ts").cast("date").alias("day"))
        .agg(F.count("*").alias("calls"))
        .withColumn("remaining", F.greatest(F.lit(cap) - F.col("calls"), F.lit(0)))
        .withColumn("over_cap", F.col("calls") > cap)
    )


def rate_demand(requests: DataFrame, windows: dict[str, int] | None = None) -> DataFrame:
    """Trailing request counts per address over 60 s, 3600 s and 86400 s, both ends included.

    A count over [t - w, t] is the number of requests up to t minus the number
    before t - w. Both are ranks: a prefix sum over per-minute totals plus a
    rank inside one minute, so no window ever spans a whole address.
    """
    windows = windows or {"last_minute": 60, "last_hour": 3600, "last_day": 86400}
    r = requests.select("visit_id", "ip", epoch_us(F.col("ts")).alias("us"))
    probes = F.array(
        F.struct(F.lit("rank").alias("kind"), F.col("us").alias("at"), F.lit(1).alias("real")),
        *[F.struct(F.lit(k).alias("kind"), (F.col("us") - s * 1_000_000).alias("at"),
                   F.lit(0).alias("real")) for k, s in windows.items()],
    )
    u = r.select("visit_id", "ip", F.inline(probes)).withColumn(
        "minute", F.floor(F.col("at") / 60_000_000)
    )
    per_min = u.groupBy("ip", "minute").agg(F.sum("real").alias("in_minute"))
    upto = Window.partitionBy("ip").orderBy("minute").rowsBetween(Window.unboundedPreceding, -1)
    per_min = per_min.select(
        "ip", "minute", F.coalesce(F.sum("in_minute").over(upto), F.lit(0)).alias("before")
    )
    inside = Window.partitionBy("ip", "minute").orderBy("at")
    le = F.sum("real").over(inside)  # requests at or before `at`
    same = F.sum("real").over(Window.partitionBy("ip", "minute", "at"))
    ranked = u.join(per_min, ["ip", "minute"]).withColumn(
        "rank", F.col("before") + le - F.when(F.col("real") == 0, same).otherwise(0)
    )
    at = lambda k: F.max(F.when(F.col("kind") == k, F.col("rank")))
    return ranked.groupBy("visit_id", "ip").agg(
        *[(at("rank") - at(k)).alias(k) for k in windows]
    )
