"""Structured Streaming twins of the batch operators.

Event time is the visit's own time; every stateful step has a watermark, so
late rows are counted out by Spark and state stays bounded.
"""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener

from ..functions.timecode import epoch_us, local_date, local_ts
from ..functions.web import DEVICE_BUCKETS, device_bucket
from ..operators.analytics import ALLOWED_EVENTS, FUNNEL_STAGES, IDLE_SECONDS, VISIT_PATHS
from ..operators.limits import Limit
from ..operators.live import stop_board
from ..operators.tracking import measured
from ..session import scratch_path
from ..sources.sinks import upsert_daily
from .state import (
    FirstVisit, OrderedFirstVisit, OrderedRateLimiter, OrderedTripTracker, RateLimiter, TripTracker)

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: What a prediction is about.
PREDICTED = ["mode", "line_code", "stop_id", "destination"]


def keyed_state(df: DataFrame) -> None:
    """Large keyed state lives in RocksDB, checkpointed to the shared folder."""
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


class LateRows(StreamingQueryListener):
    """Counts the rows that each operator of each stream dropped as late, report by report.

    A query keeps only its newest reports; this listener sees all of them. With
    `attach` it is heard for a session, `save` appends what it has counted to a table.
    """

    SCHEMA = "run_id string, name string, operator int, dropped long, reports long"

    def __init__(self) -> None:
        self.counted: dict[tuple[str, str, int], list[int]] = {}
        self.over: dict[str, threading.Event] = {}

    def attach(self, spark: SparkSession) -> LateRows:
        spark.streams.addListener(self)
        return self

    def ended(self, run_id: str) -> threading.Event:
        return self.over.setdefault(str(run_id), threading.Event())

    def onQueryStarted(self, event) -> None:
        self.ended(event.runId)

    def onQueryProgress(self, event) -> None:
        p = event.progress
        for i, s in enumerate(p.stateOperators):
            seen = self.counted.setdefault((str(p.runId), p.name or "", i), [0, 0])
            seen[0] += s.numRowsDroppedByWatermark
            seen[1] += 1

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended(event.runId).set()

    def dropped(self, run_id: str, wait: float = 60.0) -> int:
        """Late rows of a finished run; its last report is waited for."""
        self.ended(run_id).wait(wait)
        return sum(n for (run, _, _), (n, _) in self.counted.items() if run == str(run_id))

    def save(self, spark: SparkSession, path: str, run_id: str) -> None:
        """Appends the counts of a finished run to the table at `path`."""
        self.dropped(run_id)
        rows = [(*k, *v) for k, v in sorted(self.counted.items()) if k[0] == str(run_id)]
        spark.createDataFrame(rows, self.SCHEMA).write.mode("append").parquet(path)


def run_available(writer: DataStreamWriter, checkpoint: str, late: str | None = None) -> int:
    """Process what is there and stop; the number of rows that came too late is returned.

    `late` names a table to which the counts by operator are appended.
    """
    spark = SparkSession.active()
    heard = LateRows().attach(spark)
    try:
        q: StreamingQuery = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        q.awaitTermination()
        if late:
            heard.save(spark, late, q.runId)
        return heard.dropped(q.runId)
    finally:
        spark.streams.removeListener(heard)


def to_table(df: DataFrame, label: str, late: str | None = None) -> DataFrame:
    """Run a stream over the available input into a Parquet table and read it."""
    path = scratch_path(df.sparkSession, label)
    run_available(df.writeStream.format("parquet").option("path", path).outputMode("append"), path + "-state", late)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# --- daily counters -----------------------------------------------------------------


def daily_counters(visits: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Visits, searches per hour, devices and named events per local day.

    The local clock is the event time, so a day is one tumbling window and its
    state goes when the watermark passes its end.
    """
    lt = local_ts(F.col("ts"))
    v = visits.withColumn("at", lt.cast("timestamp")).withWatermark("at", delay)
    rec, ping = F.col("path") == "/recommend", F.col("path") == "/ping"
    hours = [F.count_if(rec & (F.hour("at") == h)) for h in range(24)]
    kinds = [F.count_if(ping & (device_bucket(F.col("user_agent")) == d)).alias(d) for d in DEVICE_BUCKETS]
    names = [F.count_if(F.col("event_name") == n).alias(n) for n in ALLOWED_EVENTS]
    return v.groupBy(F.window("at", "1 day")).agg(
        F.count_if(F.col("path").isin(VISIT_PATHS)).alias("visits"), F.hll_sketch_agg("ip").alias("visitors"),
        F.array(*hours).alias("hours"), *kinds, *names,
    ).select(F.to_date("window.start").alias("date"), F.col("visits"), F.hll_sketch_estimate("visitors").alias("daily_active"),
             "hours", *DEVICE_BUCKETS, *ALLOWED_EVENTS)


def stream_daily_counters(visits: DataFrame, path: str, checkpoint: str, delay: str = "10 minutes") -> None:
    """Keep a daily table current: each batch replaces the days it touched."""
    run_available(
        daily_counters(visits, delay).writeStream.outputMode("update")
        .foreachBatch(lambda df, _: upsert_daily(df, path)), checkpoint)


def daily_visitors(visits: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Each (local day, address) once: the exact daily-active count is a count of rows.

    The local day is the event time, so its keys are kept until a day that
    begins more than `delay` after its end has been seen.
    """
    v = visits.where(F.col("path").isin(VISIT_PATHS)).select(local_date(F.col("ts")).alias("day"), "ip")
    v = v.withColumn("at", F.col("day").cast("timestamp")).withWatermark("at", f"1 day {delay}")
    return v.dropDuplicates(["at", "ip"]).select("day", "ip")


# --- sessions and retention -----------------------------------------------------------


def stream_sessions(visits: DataFrame, events: DataFrame | None = None, gap_seconds: int = IDLE_SECONDS,
                    delay: str = "10 minutes", stages: list[str] | None = None) -> DataFrame:
    """Sessions closed by the watermark, with their highest funnel stage.

    One row per session of (sid, local start day). Named events ride on the
    visit rows or come as a second stream: then sessions are made of visits
    alone, and an event sets the stage of the session it falls into.
    """
    names = stages or FUNNEL_STAGES
    idx = F.array_position(F.array(*[F.lit(s) for s in names]), F.col("event_name")) - 1
    visits = visits.where(F.col("path").isin(VISIT_PATHS))
    v = visits.select("sid", "ts", "path", F.coalesce(idx, F.lit(-1)).alias("stage"))
    if events is not None:
        return _sessions_with_events(visits, events.where(idx >= 0).withColumn("stage", idx), len(names), gap_seconds, delay)
    us = epoch_us(F.col("ts"))
    v = v.withColumn("day", local_date(F.col("ts"))).withColumn("us", us).withColumn(
        "at", F.col("ts").cast("timestamp")).withWatermark("at", delay)
    visit = F.col("path") != "event"
    g = v.groupBy(F.session_window("at", f"{gap_seconds} seconds"), "sid", "day").agg(
        F.min(F.when(visit, F.col("us"))).alias("start_us"), F.max(F.when(visit, F.col("us"))).alias("last_us"),
        F.count_if(visit).alias("visits"), F.count_if(F.col("path") == "/recommend").alias("recommends"),
        F.max("stage").cast("int").alias("stage"))
    return g.where(F.col("visits") > 0).drop("session_window")


def _sessions_with_events(visits: DataFrame, events: DataFrame, stages: int, gap_seconds: int, delay: str) -> DataFrame:
    """Session windows of (sid, local day) over both streams, as Spark aggregates them: one small row per open session.

    The clock runs twice as fast, so that between two microseconds there is room: a
    visit's window reaches to the gap after it, both ends included, an event's ends
    before the next microsecond. So an event joins the session whose window holds it, and
    neither opens one, prolongs one nor links two. The last time of each stage tells whether an event is one of the session.
    """
    keyed_state(visits)
    v = visits.select("sid", "ts", "path", F.lit(None).cast("int").alias("stage"))
    e = events.select("sid", "ts", F.lit("event").alias("path"), F.col("stage").cast("int").alias("stage"))
    rows = v.unionByName(e).withColumn("day", local_date(F.col("ts"))).withColumn("us", epoch_us(F.col("ts"))).withColumn(
        "at", F.timestamp_micros(F.col("us") * 2))
    visit, us = F.col("path") != "event", F.col("us")
    gap = F.when(visit, f"{2 * gap_seconds} seconds").otherwise("1 microsecond")
    g = rows.withWatermark("at", f"{delay} {delay}").groupBy(F.session_window("at", gap), "sid", "day").agg(
        F.min(F.when(visit, us)).alias("start_us"), F.max(F.when(visit, us)).alias("last_us"),
        F.count_if(visit).alias("visits"), F.count_if(F.col("path") == "/recommend").alias("recommends"),
        *(F.max(F.when(F.col("stage") == i, us)).alias(f"stage{i}") for i in range(stages)))
    own = [F.when(F.col(f"stage{i}") >= F.col("start_us"), i) for i in range(stages)]
    return g.where(F.col("visits") > 0).select(
        "sid", "day", "start_us", "last_us", "visits", "recommends", F.greatest(F.lit(-1), *own).cast("int").alias("stage"))


def stream_retention(visits: DataFrame, days: int = 90, delay: str = "10 minutes", in_order: bool = False) -> DataFrame:
    """(rid, day, returning) once per visitor and day; visitors fade after 90 quiet days.

    `in_order`: a day counts once the watermark has passed it, so that days of
    late files still come in order.
    """
    keyed_state(visits)
    v = visits.where(F.col("path") == "/ping").select(
        "rid", F.col("ts").cast("timestamp").alias("at"), epoch_us(F.col("ts")).alias("us"),
        local_date(F.col("ts")).cast("string").alias("day"))
    if in_order:
        # Visits of a day at one instant are one row; on release only the first of a day counts.
        v = v.select("rid", "at", "us", F.lit(0).cast("long").alias("tie"), F.col("day").alias("payload"))
    return v.withWatermark("at", delay).groupBy("rid").transformWithState(
        OrderedFirstVisit(days) if in_order else FirstVisit(days), "rid string, day string, returning boolean", "Append", "EventTime")


# --- limits, boards, alerts, trips -----------------------------------------------------


def stream_rate_limit(requests: DataFrame, limit: Limit, delay: str = "1 minute", in_order: bool = False) -> DataFrame:
    """Each request with `allowed`, from the accepted times kept per address.

    By default requests of a batch are decided at once, as a gate must; with
    `in_order` they are decided when the watermark has passed them, in order of
    time over all batches.
    """
    keyed_state(requests)
    r = requests.select("visit_id", "ip", F.col("ts").cast("timestamp").alias("at"), epoch_us(F.col("ts")).alias("us"))
    if in_order:
        r = r.select("ip", "at", "us", F.col("visit_id").cast("long").alias("tie"), F.lit("").alias("payload"))
    return r.withWatermark("at", delay).groupBy("ip").transformWithState(
        OrderedRateLimiter(limit) if in_order else RateLimiter(limit), "visit_id long, ip string, us long, allowed boolean", "Append", "EventTime")


def latest_predictions(arrivals: DataFrame, stale: str = "30 seconds") -> DataFrame:
    """Newest prediction per (mode, line, stop, destination) and 30-second slot; of one instant, the soonest."""
    a = arrivals.withColumn("at", F.col("fetched_at").cast("timestamp")).withWatermark("at", stale)
    return a.groupBy(F.window("at", stale), *PREDICTED).agg(
        F.max_by("minutes", F.struct("at", -F.col("minutes"))).alias("minutes"), F.max("at").alias("at")).select(
        F.col("window.start").alias("slot"), *PREDICTED, "minutes", "at")


def stream_stop_board(arrivals: DataFrame, pinned: DataFrame, path: str, checkpoint: str,
                      stale: str = "30 seconds") -> None:
    """Keep one board of the pinned stops current, whatever order predictions come in.

    The newest prediction per (mode, line, stop, destination) goes from batch
    to batch, in two folders by turns, so that a repeated batch merges the same
    rows. It is shown until the newest time seen is `stale` past its own time;
    what the watermark drops is older than that.
    """
    newest = latest_predictions(arrivals, stale).drop("slot")

    def live(spark: SparkSession, n: int) -> DataFrame:
        rows = spark.read.schema(newest.schema).parquet(f"{path}-latest/{n % 2}")
        clock = rows.agg(F.max(F.unix_micros("at"))).first()[0]
        return rows.where(F.col("at") > F.timestamp_micros(F.lit(clock).cast("long")) - F.expr(f"INTERVAL {stale}"))

    def publish(batch: DataFrame, n: int) -> None:
        spark, rows = batch.sparkSession, batch
        if n:
            rows = rows.unionByName(live(spark, n - 1))
        rows = rows.groupBy(*PREDICTED).agg(F.max_by(F.struct("minutes", "at"), F.struct("at", -F.col("minutes"))).alias("p"))
        rows.select(*PREDICTED, "p.*").write.mode("overwrite").parquet(f"{path}-latest/{n % 2}")
        stop_board(live(spark, n), pinned).write.mode("overwrite").parquet(path)

    run_available(newest.writeStream.outputMode("update").foreachBatch(publish), checkpoint)


def stream_alerts(alerts: DataFrame, refresh: str = "5 minutes") -> DataFrame:
    """Each alert id once per refresh period."""
    a = alerts.where(F.col("alert_id") != "").withColumn("at", F.col("fetched_at").cast("timestamp"))
    return a.withWatermark("at", refresh).dropDuplicatesWithinWatermark(["alert_id"]).drop("at")


def stream_trips(pings: DataFrame, legs: DataFrame, delay: str = "5 minutes", in_order: bool = False) -> DataFrame:
    """Progress of each trip; distances come from a stream-static join with its legs.

    `in_order`: pings are followed in order of time over all batches, each once
    the watermark has passed it.
    """
    keyed_state(pings)
    m = measured(pings, legs).withColumn("at", F.timestamp_micros("us")).withWatermark("at", delay)
    if in_order:
        m = m.withColumn("payload", F.to_json(F.struct("on_vehicle", "rerouted", "legs"))).select(
            "trip_id", "at", "us", F.xxhash64("payload").alias("tie"), "payload")
    return m.groupBy("trip_id").transformWithState(
        OrderedTripTracker() if in_order else TripTracker(), "trip_id long, us long, leg int, new_steps string, off_route boolean, cleared boolean",
        "Append", "EventTime")
