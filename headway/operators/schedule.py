"""Schedule processing: stop sequences, service days, timetables, departures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.timecode import (
    SLOT_MINUTES, clock_hhmm, gtfs_minutes, periods, sunday_service_holiday, weekday,
)
from ..session import deal

# Id ranges, line names, route colours with a meaning of their own.
STATION_IDS = (40000, 49999)
PLATFORM_IDS = (30000, 39999)
BUS_STOP_IDS = (0, 29999)
LINE_NAMES = {
    "Red": "Red Line", "Blue": "Blue Line", "Brn": "Brown Line", "G": "Green Line",
    "Org": "Orange Line", "P": "Purple Line", "Pink": "Pink Line", "Y": "Yellow Line",
}
EXPRESS_COLOUR = "b71234"
FREQUENT_COLOUR = "414145"
ADDED_DATES_FLOOR = 3
WEEK = ["monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"]


def line_name(code: Column) -> Column:
    pairs = [F.lit(x) for kv in LINE_NAMES.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), code), code)


# --- dimensions --------------------------------------------------------------


def classify_stops(stops: DataFrame, strict_bus: bool = False) -> DataFrame:
    """One row per known stop with `kind` station / platform / bus."""
    n = F.col("stop_id").try_cast("bigint")
    bus = n.between(*BUS_STOP_IDS)
    if strict_bus:
        bus = bus & F.col("location_type").isin("", "0")
    kind = (
        F.when(n.between(*STATION_IDS) & (F.col("location_type") == "1"), "station")
        .when(n.between(*PLATFORM_IDS) & F.col("parent_id").isNotNull(), "platform")
        .when(bus, "bus")
    )
    one = F.min(F.struct("name", "lat", "lon", "parent_id", "location_type")).alias("s")
    return (
        stops.withColumn("kind", kind).where(F.col("kind").isNotNull())
        .groupBy("stop_id", "kind").agg(one)
        .select("stop_id", "kind", "s.name", "s.lat", "s.lon", "s.parent_id", "s.location_type")
    )


def classify_routes(routes: DataFrame) -> DataFrame:
    """mode rail / bus, names with fallbacks, display category."""
    colour, kind = F.lower("color"), F.col("route_type")
    category = (
        F.when(kind == "1", "train")
        .when((kind == "3") & (colour == EXPRESS_COLOUR), "bus_express")
        .when((kind == "3") & (colour == FREQUENT_COLOUR), "bus_frequent")
        .when(kind == "3", "bus_regular")
        .otherwise("other")
    )
    named = F.when(kind == "1", line_name(F.col("route_id"))).otherwise(F.col("long_name"))
    keep_long = (kind == "1") & F.col("route_id").isin(list(LINE_NAMES))
    return routes.select(
        "route_id",
        F.coalesce(F.nullif("short_name", F.lit("")), F.col("route_id")).alias("short_name"),
        F.when(keep_long, named).otherwise(F.col("long_name")).alias("long_name"),
        "route_type", colour.alias("color"),
        F.when(kind == "1", "rail").otherwise("bus").alias("mode"),
        category.alias("category"),
    )


def natural_route_order(routes: DataFrame, name: str = "short_name") -> DataFrame:
    """Adds `sort_group, sort_number, sort_letters`: numbers, number+letters, letters."""
    c = F.col(name)
    digits = F.regexp_replace(c, r"\D", "")
    letters = F.regexp_replace(c, r"\d", "")
    group = F.when(c.rlike(r"^\d+$"), 0).when(digits != "", 1).otherwise(2)
    return routes.select(
        "*", group.alias("sort_group"),
        F.coalesce(digits.try_cast("bigint"), F.lit(0).cast("bigint")).alias("sort_number"),
        F.when(group == 0, "").when(group == 1, letters).otherwise(c).alias("sort_letters"),
    ).orderBy("sort_group", "sort_number", "sort_letters")


def category_order(category: Column) -> Column:
    """train, bus_frequent, bus_express, bus_regular, other."""
    names = ["train", "bus_frequent", "bus_express", "bus_regular", "other"]
    return F.array_position(F.array(*[F.lit(n) for n in names]), category)


def alert_picker_group(name: Column) -> Column:
    """numbers, X routes, N routes, other - the order of the alert picker."""
    return (
        F.when(name.rlike(r"^\d+$"), "numbers").when(name.rlike(r"^X\d+"), "X")
        .when(name.rlike(r"^N\d+"), "N").otherwise("other")
    )


# --- service calendar ---------------------------------------------------------


def service_days(calendar: DataFrame, calendar_dates: DataFrame) -> DataFrame:
    """(service_id, dow): weekly flags plus weekdays added on three or more dates."""
    flags = F.array(*[F.when(F.col(d), F.lit(i)) for i, d in enumerate(WEEK)])
    weekly = calendar.select("service_id", F.explode(F.array_compact(flags)).alias("dow"))
    added = calendar_dates.where(F.col("exception_type") == "1").groupBy("service_id", weekday(F.col("date")).alias("dow")).agg(
        F.count("*").alias("n"))
    return weekly.unionByName(added.where(F.col("n") >= ADDED_DATES_FLOOR).select("service_id", "dow")).distinct()


def service_buckets(calendar: DataFrame, calendar_dates: DataFrame) -> DataFrame:
    """(service_id, bucket) with bucket weekday / saturday / sunday.

    A date added on a Sunday-service holiday also gives sunday; removals are ignored.
    """
    all_week = F.col("monday") & F.col("tuesday") & F.col("wednesday") & F.col(
        "thursday") & F.col("friday")
    flags = F.array(F.when(all_week, "weekday"), F.when(F.col("saturday"), "saturday"),
                    F.when(F.col("sunday"), "sunday"))
    weekly = calendar.select("service_id", F.explode(F.array_compact(flags)).alias("bucket"))
    holiday = calendar_dates.where(
        (F.col("exception_type") == "1") & sunday_service_holiday(F.col("date"))
    ).select("service_id", F.lit("sunday").alias("bucket"))
    return weekly.unionByName(holiday).distinct()


def feed_window(calendar: DataFrame) -> DataFrame:
    return calendar.agg(F.min("start_date").alias("start_date"), F.max("end_date").alias("end_date"))


# --- stop sequences -----------------------------------------------------------


def to_parent(df: DataFrame, stops: DataFrame, stop_col: str = "stop_id") -> DataFrame:
    """Platform id replaced by its station; other ids unchanged."""
    p = stops.where(F.col("kind") == "platform").select(
        F.col("stop_id").alias(stop_col), F.col("parent_id").alias("_parent")
    )
    return df.join(p, stop_col, "left").withColumn(
        stop_col, F.coalesce("_parent", stop_col)
    ).drop("_parent")


def trip_calls(stop_times: DataFrame, trips: DataFrame, routes: DataFrame,
               stops: DataFrame) -> DataFrame:
    """Stop times of trips on known routes; rail at stations, bus at known bus stops.

    Every call with a sequence number and a time is kept, also where a feed repeats a number.
    """
    r = routes.select("route_id", "mode")
    t = trips.join(r, "route_id").select("trip_id", "route_id", "direction_id", "service_id",
                                         "mode", F.col("headsign").alias("trip_headsign"))
    known = stops.select("stop_id", "kind", "parent_id")
    usable = F.col("seq").isNotNull() & F.col("arr_min").isNotNull()
    calls = stop_times.where(usable).select("trip_id", "seq", "arr_min", "stop_id", "dep_min", "dep_text", "headsign")
    rail = F.col("mode") == "rail"
    at_platform = rail & (F.col("kind") == "platform")
    return (
        calls.join(known, "stop_id", "left").join(t, "trip_id")
        .where(rail | (F.col("kind") == "bus"))
        .withColumn("platform_id", F.col("stop_id"))
        .withColumn("stop_id", F.when(at_platform, F.col("parent_id")).otherwise(F.col("stop_id")))
        .drop("kind", "parent_id")
    )


def trip_stops(calls: DataFrame) -> DataFrame:
    """Calls in order: 0-based `pos`, `n_stops` and the trip's first minute. Equal numbers follow time, then platform."""
    w = Window.partitionBy("trip_id").orderBy("seq", "arr_min", "platform_id", "dep_min")
    whole = Window.partitionBy("trip_id")
    return calls.select(
        "*", (F.row_number().over(w) - 1).alias("pos"),
        F.count("*").over(whole).alias("n_stops"),
        F.first("arr_min").over(w).alias("first_min"),
    )


def trip_heads(calls: DataFrame) -> DataFrame:
    """One row per trip: what the choice of a representative needs.

    Counts and minima combine before the shuffle; no trip is put in order for it.
    """
    cols = ["route_id", "direction_id", "service_id", "mode"]       # the same for all calls of a trip
    return calls.groupBy("trip_id").agg(
        *(F.first(c).alias(c) for c in cols), F.count("*").alias("n_stops"),
        F.min(F.struct("seq", "arr_min"))["arr_min"].alias("first_min"))


def trip_periods(heads: DataFrame, days: DataFrame) -> DataFrame:
    """(trip_id, period): an active day, shifted past midnight, lies in the period's
    days and the first minute of the clock day in one of its windows.

    The period table is fixed and keyed by day and half-hour slot, so the range
    test is an equi-join; it is the only side that is broadcast.
    """
    p = F.broadcast(periods(heads.sparkSession)).withColumnRenamed("dow", "eff")
    first = F.floor(F.col("first_min")).cast("bigint")
    on = heads.join(days, "service_id").select(
        "trip_id", ((F.col("dow") + F.floor(first / 1440)) % 7).cast("int").alias("eff"),
        F.floor((first % 1440) / SLOT_MINUTES).cast("int").alias("slot"))
    return on.join(p, ["eff", "slot"]).select("trip_id", "period", "target_min").distinct()


def representative_trips(heads: DataFrame, in_period: DataFrame) -> DataFrame:
    """One trip per (period, route, direction): rail the longest, then nearest the target."""
    away = F.abs(F.col("first_min") - F.col("target_min"))
    length = F.when(F.col("mode") == "rail", -F.col("n_stops")).otherwise(0)
    best = F.min(F.struct(length.alias("a"), away.alias("b"), F.col("trip_id").alias("trip_id"),
                          F.col("n_stops").alias("n_stops"), F.col("mode").alias("mode")))
    return (
        heads.join(in_period, "trip_id")
        .groupBy("period", "route_id", "direction_id").agg(best.alias("x"))
        .select("period", "route_id", "direction_id", "x.mode", "x.trip_id", "x.n_stops")
    )


def representative_stops(calls: DataFrame, reps: DataFrame) -> DataFrame:
    """Stop sequences of the representative trips, per period; only their calls are put in order."""
    chosen = reps.select("trip_id").distinct()
    return trip_stops(calls.join(chosen, "trip_id", "left_semi")).join(reps.select("period", "trip_id"), "trip_id")


# --- departures and timetables ----------------------------------------------------


def last_departures(calls: DataFrame) -> DataFrame:
    """Latest rail departure per (route, direction, station), as published."""
    return (
        calls.where(F.col("mode") == "rail")
        .groupBy("route_id", "direction_id", "stop_id")
        .agg(F.max(F.struct("dep_min", "dep_text")).alias("m"))
        .select("route_id", "direction_id", "stop_id",
                F.col("m.dep_text").alias("dep_text"), F.col("m.dep_min").alias("dep_min"))
    )


def until_last(last: DataFrame, now_local: Column) -> DataFrame:
    """Clock time, minutes left or departed; 00:00-02:59 belongs to the day before."""
    now = F.hour(now_local) * 60.0 + F.minute(now_local) + F.second(now_local) / 60.0
    now = now + F.when(F.hour(now_local) < 3, 1440.0).otherwise(0.0)
    left = gtfs_minutes(F.col("dep_text")) - now
    return last.select(
        "route_id", "direction_id", "stop_id", clock_hhmm(F.col("dep_text")).alias("time"),
        F.when(left >= 0, F.bround(left).cast("int")).alias("minutes_until"),
        (left < 0).alias("departed"),
    )


def timetable_calls(stop_times: DataFrame, trips: DataFrame, buckets: DataFrame) -> DataFrame:
    """Every published call with its day bucket, over all modes and stops.

    The calls are dealt by trip, so a task sorts and groups no more than its share of them.
    `buckets` has at most three rows per service and meets the trips, never the calls.
    """
    t = trips.select("trip_id", "route_id", "direction_id", "service_id",
                     F.col("headsign").alias("trip_headsign"))
    return (
        deal(stop_times.where("hhmm IS NOT NULL"), "trip_id").join(t.join(F.broadcast(buckets), "service_id"), "trip_id")
        .withColumn("seq", F.coalesce("seq", F.lit(0)))
    )


def timetable(calls: DataFrame) -> DataFrame:
    """Sorted distinct clock times per (route, direction, stop, bucket).

    At most 1440 distinct times exist per group, so the set is bounded.
    """
    return calls.groupBy("route_id", "direction_id", "stop_id", "bucket").agg(
        F.array_sort(F.collect_set("hhmm")).alias("times"),
        F.min("seq").alias("first_seq"),
    )


def stop_order(calls: DataFrame) -> DataFrame:
    """Place of a stop on a direction: least sequence, ties by id."""
    order = Window.partitionBy("route_id", "direction_id").orderBy("seq", "stop_id")
    return (
        calls.groupBy("route_id", "direction_id", "stop_id").agg(F.min("seq").alias("seq"))
        .withColumn("stop_no", F.row_number().over(order) - 1)
    )


def headsigns(calls: DataFrame) -> DataFrame:
    """First non-empty headsign per direction, by trip and sequence."""
    sign = F.coalesce(F.col("headsign"), F.nullif("trip_headsign", F.lit("")))
    return (
        calls.where(sign.isNotNull()).groupBy("route_id", "direction_id")
        .agg(F.min_by(sign, F.struct("trip_id", "seq")).alias("headsign"))
    )


def timetable_documents(calls: DataFrame, routes: DataFrame, stops: DataFrame) -> DataFrame:
    """One nested document per route that has trips."""
    day_times = [
        F.array_sort(F.collect_set(F.when(F.col("bucket") == b, F.col("hhmm")))).alias(b)
        for b in ("weekday", "saturday", "sunday")
    ]
    times = calls.groupBy("route_id", "direction_id", "stop_id").agg(*day_times).select(
        "route_id", "direction_id", "stop_id", F.struct("weekday", "saturday", "sunday").alias("times"))
    place = stops.groupBy("stop_id").agg(F.min(F.struct("name", "lat", "lon")).alias("s")).select(
        "stop_id", "s.*")
    entry = F.struct("stop_no", "stop_id", "name", "lat", "lon", F.col("seq").alias("sequence"), "times")
    keys = ["route_id", "direction_id"]
    per_dir = (
        stop_order(calls).join(times, [*keys, "stop_id"]).join(place, "stop_id", "left")
        .groupBy(*keys)
        .agg(F.sort_array(F.collect_list(F.struct("stop_no", entry.alias("e")))).getField("e").alias("stops"))
        .join(headsigns(calls), keys, "left")
    )
    doc = F.struct("direction_id", F.coalesce("headsign", F.lit("")).alias("headsign"), "stops")
    per_route = per_dir.groupBy("route_id").agg(
        F.array_sort(F.collect_list(F.struct("direction_id", doc.alias("d")))).getField("d")
        .alias("directions")
    )
    return routes.join(per_route, "route_id")


def timetable_by_hour(calls: DataFrame, day: Column) -> DataFrame:
    """Minutes under each hour of the bucket that runs on `day`."""
    bucket = (
        F.when(sunday_service_holiday(day) | (weekday(day) == 6), "sunday")
        .when(weekday(day) == 5, "saturday").otherwise("weekday")
    )
    hm = F.split("hhmm", ":")
    return (
        calls.where(F.col("bucket") == bucket)
        .select("route_id", "direction_id", "stop_id", hm[0].cast("int").alias("hour"),
                hm[1].alias("minute")).distinct()
        .groupBy("route_id", "direction_id", "stop_id", "hour")
        .agg(F.array_sort(F.collect_list("minute")).alias("minutes"))
    )


# --- stops and lines ---------------------------------------------------------------


def stop_routes(calls: DataFrame) -> DataFrame:
    """Sorted routes serving each stop."""
    return calls.groupBy("stop_id").agg(F.array_sort(F.collect_set("route_id")).alias("routes"))


def stop_entries(rep_stops: DataFrame) -> DataFrame:
    """(stop, route, direction, position, minute) on the representative trips."""
    return rep_stops.select("period", "stop_id", "route_id", "direction_id", "pos", "arr_min")


def stop_positions(rep_stops: DataFrame) -> DataFrame:
    """Position and total per (period, stop, route), direction 0 before 1."""
    best = F.min(F.struct("direction_id", "pos", "n_stops")).alias("b")
    return rep_stops.groupBy("period", "stop_id", "route_id").agg(best).select(
        "period", "stop_id", "route_id", F.col("b.pos").alias("position"),
        F.col("b.n_stops").alias("total"))


def locate(asked: DataFrame, positions: DataFrame) -> DataFrame:
    """Position of asked (stop, route) pairs; (1, 2) where unknown."""
    return asked.join(positions, ["period", "stop_id", "route_id"], "left").withColumn(
        "position", F.coalesce("position", F.lit(1))
    ).withColumn("total", F.coalesce("total", F.lit(2).cast("bigint")))


# --- shapes -----------------------------------------------------------------------


def used_shapes(shapes: DataFrame, trips: DataFrame) -> DataFrame:
    return shapes.join(trips.select("shape_id"), "shape_id", "left_semi")


def shape_per_route(shapes: DataFrame, trips: DataFrame, routes: DataFrame) -> DataFrame:
    """(route key, direction, shape): the shape with most points, keyed by id and short name."""
    points = used_shapes(shapes, trips).groupBy("shape_id").agg(F.count("*").alias("points"))
    pick = (
        trips.where(F.col("shape_id").isNotNull())
        .select("route_id", "direction_id", "shape_id").distinct()
        .join(points, "shape_id").groupBy("route_id", "direction_id")
        .agg(F.max(F.struct("points", "shape_id")).alias("m"))
        .select("route_id", "direction_id", F.col("m.shape_id").alias("shape_id"),
                F.col("m.points").alias("points"))
    )
    named = pick.join(routes.select("route_id", "short_name"), "route_id")
    keys = F.array_distinct(F.array("route_id", "short_name"))
    return named.select(F.explode(keys).alias("route_key"), "direction_id", "shape_id", "points")
