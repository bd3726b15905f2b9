"""Joins and aggregations over arrivals, alerts, statuses and forecasts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import crowding as C
from ..functions import text
from ..functions.geo import snap2
from ..functions.timecode import epoch_us
from .schedule import LINE_NAMES

# Alert ids of rail lines, board size, direction test, limits.
ALERT_IDS = {"Red": "red", "Blue": "blue", "Brn": "brn", "G": "g", "Org": "org", "P": "p",
             "Pink": "pink", "Y": "y"}
LOADS = {"Empty": "EMPTY", "Half-Full": "HALF_EMPTY", "Full": "FULL"}
LOAD_LABELS = {"low": "light", "moderate": "moderate", "high": "busy", "very_high": "very crowded"}
BOARD_SIZE = 3
SHORT_HOP_DEGREES = 0.005
AMBIGUOUS_MARGIN = 0.15
SIGNIFICANT = 40
FORECAST_SECONDS = 1800


def _map(table: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])


# --- filters -------------------------------------------------------------------


def filter_load(arrivals: DataFrame, load: str) -> DataFrame:
    """Arrivals with the asked passenger load; `All` keeps everything."""
    return arrivals if load == "All" else arrivals.where(F.col("load") == LOADS.get(load, ""))


def significant_alerts(alerts: DataFrame) -> DataFrame:
    return alerts.where(F.col("severity") >= SIGNIFICANT)


def disrupted(statuses: DataFrame) -> DataFrame:
    return statuses.where(F.lower("status") != "normal service")


# --- arrivals ------------------------------------------------------------------


def catchable(arrivals: DataFrame, walks: DataFrame) -> DataFrame:
    """Earliest arrival one can still reach, per (walk, line, stop, destination).

    `walks` has (walk_id, stop_id, walk_minutes). Arrivals shrink to one row
    per (line, stop, destination, minute) before they meet the walks.
    """
    distinct = arrivals.select("line_code", "stop_id", "destination", "minutes").distinct()
    return (
        distinct.join(walks, "stop_id").where(F.col("minutes") >= F.col("walk_minutes"))
        .groupBy("walk_id", "line_code", "stop_id", "destination").agg(F.min("minutes").alias("minutes"))
    )


def earliest(arrivals: DataFrame) -> DataFrame:
    return arrivals.groupBy("line_code", "stop_id").agg(F.min("minutes").alias("minutes"))


def resolve_terminal(names: DataFrame, stations: DataFrame, exact_ratio: bool = True) -> DataFrame:
    """Coordinates of destination names: equal, else containing either way.

    Containment is blocked on the first three letters of the shorter name,
    which must be among the three-letter pieces of the longer. Among several,
    the closest length wins, then the higher similarity, then the least id.
    """
    n = names.select(F.lower(F.trim("destination")).alias("n")).distinct()
    st = stations.where(F.trim("name") != "").select(
        F.lower(F.trim("name")).alias("s"), "stop_id", "lat", "lon")
    st = st.groupBy("s").agg(F.min(F.struct("stop_id", "lat", "lon")).alias("p"))
    known = n.join(st, n["n"] == st["s"]).select("n", "p")
    rest = n.join(known, "n", "left_anti").where(F.col("n") != "")
    piece = lambda c: F.array_distinct(F.flatten(F.array(
        *[text.grams(F.col(c), q) for q in (1, 2, 3)])))
    head = lambda c: F.substring(c, 1, 3)
    a = rest.select("n", F.explode(piece("n")).alias("k")).join(
        st.select("s", "p", head("s").alias("k")), "k").where(F.contains("n", "s"))
    b = rest.select("n", head("n").alias("k")).join(
        st.select("s", "p", F.explode(piece("s")).alias("k")), "k").where(F.contains("s", "n"))
    both = a.select("n", "s", "p").unionByName(b.select("n", "s", "p")).distinct()
    gap = F.abs(F.length("s") - F.length("n"))
    tied = both.withColumn("gap", gap).withColumn(
        "least", F.min("gap").over(Window.partitionBy("n"))).where(F.col("gap") == F.col("least"))
    ratio = text.matching_ratio if exact_ratio else text.edit_similarity
    scored = tied.withColumn("r", ratio(F.col("n"), F.col("s")))
    near = scored.groupBy("n").agg(F.min(F.struct((-F.col("r")).alias("r"), "p")).alias("b")).select(
        "n", F.col("b.p").alias("p"))
    return known.unionByName(near).select(
        F.col("n").alias("terminal"), "p.stop_id", "p.lat", "p.lon")


def pick_wait(legs: DataFrame, arrivals: DataFrame, places: DataFrame, terminals: DataFrame) -> DataFrame:
    """Wait of each leg: the arrival that heads the leg's way.

    `legs`: leg_id, walk_id, line_code, from_id, to_id, final_id; `arrivals` as
    from `catchable`; `places`: stop_id, lat, lon; `terminals`: terminal, lat, lon.
    """
    p = places.select("stop_id", F.struct("lat", "lon").alias("p"))
    at = lambda c, n: p.select(F.col("stop_id").alias(c), F.col("p").alias(n))
    l = legs.join(at("from_id", "a"), "from_id", "left").join(at("to_id", "b"), "to_id", "left").join(
        at("final_id", "f"), "final_id", "left")
    size = lambda v: F.sqrt(v["y"] * v["y"] + v["x"] * v["x"])
    vec = lambda u, v: F.struct((F.col(v)["lat"] - F.col(u)["lat"]).alias("y"),
                                (F.col(v)["lon"] - F.col(u)["lon"]).alias("x"))
    l = l.withColumn("hop", vec("a", "b")).withColumn("far", vec("a", "f"))
    further = (size(F.col("hop")) < SHORT_HOP_DEGREES) & (F.col("final_id") != F.col("to_id")) & (
        size(F.col("far")) > size(F.col("hop")))
    l = l.withColumn("dir", F.when(further, F.col("far")).otherwise(F.col("hop")))
    hits = l.join(arrivals.select("walk_id", "line_code", F.col("stop_id").alias("from_id"), "destination",
                                  "minutes"), ["walk_id", "line_code", "from_id"])
    t = terminals.select(F.col("terminal").alias("_t"), F.struct("lat", "lon").alias("t"))
    hits = hits.join(t, F.lower(F.trim("destination")) == F.col("_t"), "left")
    to_t = vec("a", "t")
    dot = F.col("dir")["y"] * to_t["y"] + F.col("dir")["x"] * to_t["x"]
    cos = dot / F.nullif(size(F.col("dir")) * size(to_t), F.lit(0.0))
    hits = hits.withColumn("cos", F.when(cos > 0, cos))
    pos = F.col("cos").isNotNull()
    order = Window.partitionBy("leg_id").orderBy(F.desc_nulls_last("cos"), "minutes")
    g = hits.withColumn("r", F.row_number().over(order)).groupBy("leg_id").agg(
        F.count("*").alias("n"), F.min("minutes").alias("soonest"),
        F.max(F.when((F.col("r") == 1) & pos, F.struct("cos", "minutes"))).alias("one"),
        F.max(F.when((F.col("r") == 2) & pos, F.col("cos"))).alias("two"))
    clear = F.col("one").isNotNull() & (
        F.col("two").isNull() | (F.col("one.cos") - F.col("two") >= AMBIGUOUS_MARGIN))
    wait = F.when((F.col("n") > 1) & clear, F.col("one.minutes")).otherwise(F.col("soonest"))
    return g.select("leg_id", wait.alias("wait"))


def transfer_boardings(legs: DataFrame) -> DataFrame:
    """Distinct stops where a transit leg after the first is boarded, with its mode."""
    w = Window.partitionBy("od_id", "itin_id").orderBy("leg_no")
    later = legs.where(F.col("leg_type") == "transit").withColumn("n", F.row_number().over(w)).where("n > 1")
    rail = F.col("line_code").isin(list(LINE_NAMES)) | (F.col("mode") == "rail")
    return later.select(F.when(rail, "rail").otherwise("bus").alias("mode"), "line_code",
                        F.col("from_id").alias("stop_id")).distinct()


def stop_board(arrivals: DataFrame, pinned: DataFrame) -> DataFrame:
    """Next three arrivals per pinned stop; a pinned stop without any is kept, empty."""
    w = Window.partitionBy("mode", "stop_id").orderBy("minutes", "line_code", "destination")
    top = arrivals.join(pinned.select("mode", "stop_id").distinct(), ["mode", "stop_id"], "left_semi").withColumn(
        "n", F.row_number().over(w)).where(F.col("n") <= BOARD_SIZE)
    board = top.groupBy("mode", "stop_id").agg(F.array_sort(F.collect_list(
        F.struct("n", F.col("line_code").alias("route"), "destination", "minutes"))).alias("arrivals"))
    keys = pinned.where(F.col("mode").isin("train", "bus")).select("mode", "stop_id").distinct()
    empty = F.array().cast(board.schema["arrivals"].dataType)
    return keys.join(board, ["mode", "stop_id"], "left").select(
        F.concat_ws(":", "mode", "stop_id").alias("key"), F.coalesce("arrivals", empty).alias("arrivals"))


# --- alerts and service -----------------------------------------------------------


def dedupe_alerts(alerts: DataFrame, order: str = "seq") -> DataFrame:
    """First copy of each alert id, most severe first; alerts without id drop."""
    rest = [c for c in alerts.columns if c not in ("alert_id", order)]
    return (
        alerts.where(F.col("alert_id") != "").groupBy("alert_id")
        .agg(F.min_by(F.struct(*rest), order).alias("a")).select("alert_id", "a.*")
        .orderBy(F.desc("severity"), "alert_id")
    )


def alert_id(line_code: Column) -> Column:
    return F.coalesce(F.try_element_at(_map(ALERT_IDS), line_code), line_code)


def alerts_for(legs: DataFrame, alerts: DataFrame, lists: bool = False) -> DataFrame:
    """(itinerary, alert) pairs: alerts that name a line or bus the itinerary rides.

    Itineraries that ride the same lines have the same alerts, so alerts meet
    each distinct set of lines once. `lists`: one row per itinerary with the
    number of its `alerts` and their `alert_ids` in order, in place of the pairs.
    """
    rides = legs.where((F.col("leg_type") == "transit") & (F.col("line_code") != "")).groupBy("od_id", "itin_id").agg(
        F.array_sort(F.collect_set(alert_id(F.col("line_code")))).alias("routes"))
    named = alerts.select("alert_id", F.explode("affected_routes").alias("route")).distinct()
    sets = rides.select("routes").distinct().select("routes", F.explode("routes").alias("route"))
    of_set = sets.join(named, "route").select("routes", "alert_id").distinct()
    if lists:
        of_set = of_set.groupBy("routes").agg(F.count("*").alias("alerts"), F.array_sort(F.collect_list("alert_id")).alias("alert_ids"))
    return rides.join(of_set, "routes").drop("routes")


def alerts_selected(alerts: DataFrame, lines: list[str], buses: list[str]) -> DataFrame:
    """Alerts touching any selected line or bus; nothing selected shows nothing."""
    wanted = F.array(*[F.lit(x) for x in [*lines, *buses]]).cast("array<string>")
    short = F.transform("routes", lambda r: F.regexp_replace(r, " Line$", ""))
    return alerts.where(F.arrays_overlap(short, wanted))


def active_buses(bus_routes: DataFrame, routes: DataFrame) -> DataFrame:
    """Buses in service with feed names where the schedule has none."""
    r = routes.where(F.col("short_name") != "").groupBy(F.col("short_name").alias("route")).agg(
        F.min(F.struct("long_name", F.col("color").alias("c"))).alias("r"))
    own = F.concat(F.lit("#"), F.ltrim(F.col("color"), F.lit("#")))
    return bus_routes.select("route", "name", "color").distinct().join(r, "route", "left").select(
        "route", F.coalesce("r.long_name", "name").alias("name"),
        F.coalesce(F.concat(F.lit("#"), F.col("r.c")), own).alias("color"))


def active_lines(positions: DataFrame) -> DataFrame:
    return positions.groupBy("line_code", "line").agg(F.sum("active_trains").alias("active_trains"))


# --- weather ------------------------------------------------------------------------


def forecast_intervals(forecasts: DataFrame, within: int = FORECAST_SECONDS) -> DataFrame:
    """(c_lat, c_lon, since, until, f): each forecast from its time until the next of its cell, `within` seconds at most.

    Half-open, in microseconds. An interval ends in its own time bucket or the
    next, so a cell is ordered bucket by bucket. Of forecasts of one instant one counts.
    """
    us = within * 1_000_000
    cell = ["c_lat", "c_lon"]
    f = forecasts.select(snap2(F.col("lat")).alias("c_lat"), snap2(F.col("lon")).alias("c_lon"),
                         epoch_us(F.col("ts")).alias("since"), F.struct("*").alias("f")).where("since is not null")
    f = f.withColumn("bucket", F.floor(F.col("since") / us))
    w = Window.partitionBy(*cell, "bucket").orderBy("since", F.xxhash64("f"))
    onward = f.groupBy(*cell, (F.col("bucket") - 1).alias("bucket")).agg(F.min("since").alias("onward"))
    f = f.withColumn("next", F.lead("since").over(w)).join(onward, [*cell, "bucket"], "left")
    until = F.least(F.col("since") + us + 1, F.coalesce("next", "onward"))
    return f.select(*cell, "since", until.alias("until"), "f").where("until > since")


def weather_asof(requests: DataFrame, forecasts: DataFrame, within: int = FORECAST_SECONDS) -> DataFrame:
    """Each request with the latest forecast of its two-decimal cell, at most 30 min old.

    An equi-join on (cell, bucket) with the intervals in which forecasts hold:
    one matches at most. Requests are neither ordered nor grouped, so a cell
    with any share of them only makes a join partition that Spark may split.
    A request without a point or time has no forecast.
    """
    us = within * 1_000_000 // 4
    f = forecast_intervals(forecasts, within)
    f = f.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("since") / us), F.floor((F.col("until") - 1) / us))))
    r = requests.select(F.struct("*").alias("r"), snap2(F.col("lat")).alias("r_lat"), snap2(F.col("lon")).alias("r_lon"),
                        epoch_us(F.col("ts")).alias("at"))
    met = ((F.col("r_lat") == F.col("c_lat")) & (F.col("r_lon") == F.col("c_lon")) & (F.floor(F.col("at") / us) == F.col("bucket"))
           & (F.col("at") >= F.col("since")) & (F.col("at") < F.col("until")))
    return r.join(f, met, "left").select("r.*", F.col("f").alias("forecast"))


def forecast_turn(current: Column, coming: Column) -> Column:
    """Hint from the precipitation types of the next hours; the first is skipped."""
    say = F.lit(None).cast("string")
    for i in (2, 1):
        t = F.get(coming, F.lit(i))
        say = F.when((current != "none") & (t == "none"), f"(forecast: clears in ~{i + 1}h)").when(
            (current == "none") & (t != "none"),
            F.concat(F.lit("(forecast: "), t, F.lit(f" starts in ~{i + 1}h)"))).otherwise(say)
    return F.when(F.size(coming) < 2, "").otherwise(F.coalesce(say, F.lit("")))


# --- crowding -----------------------------------------------------------------------


def crowding_by_itinerary(legs: DataFrame, holidays: DataFrame) -> DataFrame:
    """Worst crowding level over the transit legs of each itinerary.

    `legs`: od_id, itin_id, mode, line, stop_id, position, total, local (time),
    optionally load; `holidays`: date.
    """
    h = holidays.select(F.col("date").alias("_h")).distinct()
    l = legs.join(h, legs["local"].cast("date") == h["_h"], "left")
    day = C.day_type(F.col("local"), F.col("_h").isNotNull())
    period = C.time_period(F.col("local"), day)
    way = F.when(F.col("mode") == "bus", C.bound(F.col("line"))).otherwise("inbound")
    load = F.col("load") if "load" in legs.columns else None
    e = C.estimate(period, way, F.hour("local"), F.col("position"), F.col("total"), F.col("stop_id"), load)
    worst = F.max(F.struct(C.ordinal(F.col("e.level")).alias("o"), F.col("e.level").alias("level"))).alias("w")
    return l.withColumn("e", e).groupBy("od_id", "itin_id").agg(
        worst, F.max("e.score").alias("score")).select(
        "od_id", "itin_id", "w.level", _map(LOAD_LABELS)[F.col("w.level")].alias("label"), "score")
