"""Itineraries for whole tables of origin-destination pairs.

Search runs in a fixed number of rounds (one per ride). A label goes only if k
strictly cheaper ones at the same stop and line have visited nothing it has
not (each may then be continued wherever it may), or if it already costs more
than the k-th best itinerary found so far, or more than the limit of its pair
leaves for the rest of the way. None of these loses a k-best itinerary.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..session import release_shuffles, save_table
from .schedule import LINE_NAMES
from .spatial import (
    BUS_K, RAIL_K, RAIL_RINGS, TRANSFER_MINUTES, bus_rings, cell_pairs, radius_join, ring_nearest,
)
from .walk_map import WalkMap

# Limits of the searches.
MAX_RADIUS = RAIL_RINGS[-1]
MAX_TRANSFERS = 2
TOP_K = 5
MAX_EXIT_MILES, MAX_TRANSFER_MILES = 0.5, 0.25
FORWARD_RATIO, SCORE_PER_MILE, PER_ARRIVAL = 0.9, 25.8, 3
MAX_TRIP_MINUTES = 90.0
#: Miles of both walks that are tried before the full ones; minutes by which rounded scores may differ.
SHORT_REACH, SCORE_SLACK = 0.25, 1e-6
#: Minutes above the least total by which limits of a search with changes rise; first rides that are searched without such limits.
LIMIT_STEPS, LABELS_AT_ONCE = [0.0, 2.0, 5.0, 10.0, 20.0, 40.0], 1_000_000
#: Labels up to which walks are joined to them; beyond that walks are held by every task, this many at most; labels it takes at a time.
LABELS_JOINED, WALKS_AT_ONCE, LABELS_A_GROUP = 100_000, 20_000_000, 50_000
SHAPE_POINTS, SHAPE_DECIMALS = 100, 5
SAME_CORNER_M, ONE_BLOCK_M = 9.0, 120.0

LEG = ("struct<leg_type:string,mode:string,route_id:string,line:string,from_id:string,"
       "to_id:string,minutes:double>")


def leg(kind: str, mode, route, line, a, b, minutes: Column) -> Column:
    as_col = lambda c: c if isinstance(c, Column) else F.lit(c)
    return F.struct(
        F.lit(kind).alias("leg_type"), as_col(mode).alias("mode"), as_col(route).alias("route_id"),
        as_col(line).alias("line"), as_col(a).alias("from_id"), as_col(b).alias("to_id"),
        minutes.cast("double").alias("minutes"))


def _walk(a, b, minutes: Column) -> Column:
    none = F.lit(None).cast("string")
    return leg("walk", "walk", none, none, a, b, minutes)


# --- access ---------------------------------------------------------------------


def dedupe_by_line(candidates: DataFrame, lines: DataFrame) -> DataFrame:
    """In walking order keep a stop only when it adds a line; stops without lines stay.

    `candidates`: od_id, stop_id, walk_minutes (a handful per pair, from the
    ring search); `lines`: stop_id, line.
    """
    per_stop = lines.groupBy("stop_id").agg(F.array_sort(F.collect_set("line")).alias("lines"))
    none = F.array().cast("array<string>")
    c = candidates.join(per_stop, "stop_id", "left").withColumn("lines", F.coalesce("lines", none))
    items = F.array_sort(F.collect_list(F.struct("walk_minutes", "stop_id", "lines")))
    start = F.struct(F.slice(F.col("items"), 1, 0).alias("kept"), none.alias("seen"))
    new = lambda s, x: (F.size(x["lines"]) == 0) | (
        F.size(F.array_except(x["lines"], s["seen"])) > 0)
    fold = F.aggregate("items", start, lambda s, x: F.struct(
        F.when(new(s, x), F.concat(s["kept"], F.array(x))).otherwise(s["kept"]).alias("kept"),
        F.when(new(s, x), F.array_union(s["seen"], x["lines"])).otherwise(s["seen"]).alias("seen")))
    return c.groupBy("od_id").agg(items.alias("items")).select(
        "od_id", F.inline(fold["kept"])).drop("lines")


def serving_lines(edges: DataFrame) -> DataFrame:
    """(stop_id, line) of the transit edges that leave a stop."""
    e = edges.where(F.col("edge_type") == "transit")
    named = F.array_union(F.array("line"), F.coalesce(
        F.transform("all_routes", lambda r: r["line"]), F.array().cast("array<string>")))
    return e.select(F.col("from_id").alias("stop_id"), F.explode(named).alias("line")).distinct()


def access_stops(points: DataFrame, stops: DataFrame, lines: DataFrame) -> DataFrame:
    """Stops to walk to from each (od_id, lat, lon): 3 rail by ring and line, 5 bus."""
    st, bus = stops.where(F.col("kind") == "station"), stops.where(F.col("kind") == "bus")
    cols = ["od_id", "stop_id", "walk_minutes"]
    place = lambda df: df.select("stop_id", "lat", "lon")
    rail = ring_nearest(points, place(st), RAIL_RINGS, RAIL_K).select(*cols)
    near = ring_nearest(points, place(bus), bus_rings(), BUS_K).select(*cols)
    return dedupe_by_line(rail, lines).select(*cols).withColumn("mode", F.lit("rail")).unionByName(
        near.withColumn("mode", F.lit("bus")))


def coverage_status(od: DataFrame, access: DataFrame, egress: DataFrame) -> DataFrame:
    """`ok`, or `out_of_coverage` with the side that has no station within two miles."""
    has = lambda df, n: df.where(F.col("mode") == "rail").select("od_id").distinct().withColumn(n, F.lit(True))
    j = od.select("od_id").join(has(access, "a"), "od_id", "left").join(has(egress, "e"), "od_id", "left")
    no_a, no_e = F.col("a").isNull(), F.col("e").isNull()
    side = F.when(no_a & no_e, "both").when(no_a, "origin").when(no_e, "destination")
    return j.select(
        "od_id", F.when(side.isNull(), "ok").otherwise("out_of_coverage").alias("status"), side.alias("side"),
        F.when(side.isNotNull(), MAX_RADIUS).alias("max_radius"))


# --- search ------------------------------------------------------------------------


def _keep_best(labels: DataFrame, k: int, found: DataFrame) -> DataFrame:
    """Labels that may still be part of one of the k best itineraries."""
    one = Window.partitionBy("od_id", "stop_id", "route_id", "signature").orderBy("cost")
    kth = Window.partitionBy("od_id").orderBy("total")
    bound = found.groupBy("od_id", "signature").agg(F.min("total").alias("total")).withColumn(
        "_n", F.row_number().over(kth)).where(F.col("_n") == k).select("od_id", F.col("total").alias("_bound"))
    # dealt by pair once, which serves the window, the join and the groups
    left = labels.repartition("od_id").withColumn("_s", F.row_number().over(one)).where("_s = 1").drop("_s").join(bound, "od_id", "left").where(
        F.col("_bound").isNull() | (F.col("cost") <= F.col("_bound")))
    rest = [c for c in labels.columns if c not in ("od_id", "stop_id", "route_id")]
    row = F.struct("cost", "signature", *(c for c in rest if c not in ("cost", "signature")))
    beaten = lambda kept, x: F.size(F.filter(kept, lambda y: (y["cost"] < x["cost"]) & (
        F.size(F.array_except(y["seen"], x["seen"])) == 0))) >= k
    keep = lambda kept, x: F.when(beaten(kept, x), kept).otherwise(F.concat(kept, F.array(x)))
    return left.groupBy("od_id", "stop_id", "route_id").agg(F.array_sort(F.collect_list(row)).alias("_rows")).select(
        "od_id", "stop_id", "route_id", F.inline(F.aggregate("_rows", F.slice("_rows", 1, 0), keep))).select(*labels.columns)


def itineraries(od: DataFrame, access: DataFrame, egress: DataFrame, rides: DataFrame,
                walks: DataFrame, k: int = TOP_K, max_transfers: int = MAX_TRANSFERS,
                walk_factor: float = 1.0) -> DataFrame:
    """The k best distinct itineraries per pair: walk, one to three rides, walk.

    `od`: od_id, period and, where the pace of a pair is its own, walk_factor; `access` / `egress`: od_id, stop_id, walk_minutes;
    `rides`: period, route_id, mode, line, board_id, alight_id, minutes;
    `walks`: period, from_id, to_id, minutes. Total = ride + walk * factor +
    3 minutes per transfer, the sum the ranking uses. Each round is written to
    the shared folder, so no round is computed twice.

    Where the first rides of all pairs are many, itineraries with changes are searched up to a
    limit per pair that rises from the least total they can have. A pair is done once its k-th best
    is within its limit: all that cost no more have been met by then. The others go on.
    """
    fastest = save_table(rides.groupBy("period", "route_id", "mode", "line", "board_id", "alight_id").agg(
        F.min("minutes").alias("ride")), "fastest")
    walks = save_table(walks.select("period", "from_id", "to_id", "minutes"), "walks")
    release_shuffles(od.sparkSession)
    paced = save_table(od.select("od_id", "period", (F.col("walk_factor") if "walk_factor" in od.columns else F.lit(walk_factor)).cast("double").alias("factor")), "paces")
    factor = F.col("factor")
    start = save_table(access.join(paced, "od_id").select(
        "od_id", "period", "factor", "stop_id", F.lit(None).cast("string").alias("route_id"),
        F.array(_walk("origin", F.col("stop_id"), F.col("walk_minutes"))).alias("legs"),
        F.array(F.col("stop_id")).alias("seen"), F.lit("").alias("signature"),
        F.lit(0.0).alias("transit_minutes"), F.col("walk_minutes").cast("double").alias("walk_minutes"),
        (F.col("walk_minutes") * factor).alias("cost")), "starts")
    out = save_table(egress.select("od_id", "stop_id", F.col("walk_minutes").alias("exit_walk")), "exits")
    ride = fastest.withColumnRenamed("route_id", "next_route")
    # without a change: rides from a start to an exit of the pair
    ends = out.select("od_id", F.col("stop_id").alias("alight_id")).distinct()
    direct = start.join(ends, "od_id").join(ride.withColumn("stop_id", F.col("board_id")), ["period", "stop_id", "alight_id"])
    found = save_table(_k_best(_union([_finish(start, out, 0), _finish(_rode(direct), out, 0)]), k), "found")
    if max_transfers < 1:
        return found
    open_ = save_table(_least_totals(paced, start, out, fastest, walks), "least-totals")
    for step in [*LIMIT_STEPS, None]:
        kth = found.where(F.col("rank") == k).select("od_id", F.col("total").alias("kth"))
        if "limit" in open_.columns:
            open_ = open_.join(kth, "od_id", "left").where("kth is null or kth > limit").drop("kth", "limit")
        asked = save_table(open_.join(kth, "od_id", "left").where(F.col("kth").isNull() | (F.col("least") <= F.col("kth") + SCORE_SLACK)), "asked")
        work = asked.agg(F.sum("labels")).first()[0]
        if work is None:
            return found
        last = step is None or work <= LABELS_AT_ONCE
        asked = asked.withColumn("limit", F.col("kth") if last else F.least(F.col("kth"), F.col("least") + step)).drop("kth")
        more = _with_changes(asked, start, out, paced, ride, walks, found, k, max_transfers)
        found = save_table(_k_best(found.drop("rank").unionByName(more), k), "found")
        release_shuffles(od.sparkSession)
        if last:
            return found
        open_ = asked


def _k_best(itins: DataFrame, k: int) -> DataFrame:
    return rank_itineraries(distinct_itineraries(itins), k=k)


def _least_totals(paced: DataFrame, start: DataFrame, out: DataFrame, fastest: DataFrame, walks: DataFrame) -> DataFrame:
    """Per pair: the least that the way up to the end of a first ride (`begin`), a change and the way from the last
    boarding (`finish`) can cost, their sum, and the number of first rides."""
    leaving = fastest.groupBy("period", F.col("board_id").alias("stop_id")).agg(F.min("ride").alias("_ride"), F.count("*").alias("_n"))
    coming = fastest.groupBy("period", F.col("alight_id").alias("stop_id")).agg(F.min("ride").alias("_ride"))
    begin = start.join(leaving, ["period", "stop_id"]).groupBy("od_id").agg(
        F.min(F.col("cost") + F.col("_ride")).alias("begin"), F.sum("_n").alias("labels"))
    finish = out.join(paced, "od_id").join(coming, ["period", "stop_id"]).groupBy("od_id").agg(
        F.min(F.col("exit_walk") * F.col("factor") + F.col("_ride")).alias("finish"))
    afoot = walks.groupBy("period").agg(F.min("minutes").alias("_w"))
    change = paced.join(afoot, "period", "left").groupBy("od_id").agg(
        F.min(F.least(F.col("_w"), F.lit(TRANSFER_MINUTES)) * F.col("factor") + TRANSFER_MINUTES).alias("change"))
    return begin.join(finish, "od_id").join(change, "od_id").withColumn("least", F.col("begin") + F.col("change") + F.col("finish"))


def _within(cost: Column, most: Column) -> Column:
    """`cost` is at most `most`; a null `most` is no limit."""
    return most.isNull() | (cost <= most + SCORE_SLACK)


def _rode(hop: DataFrame, *more: str) -> DataFrame:
    """Labels after one more ride: rows of a label and the ride it takes."""
    sig = F.concat_ws("|", F.nullif("signature", F.lit("")), F.concat(
        F.col("next_route"), F.lit(":"), F.col("board_id"), F.lit(">"), F.col("alight_id")))
    return hop.where(_fresh()).select(
        "od_id", "period", "factor", F.col("alight_id").alias("stop_id"), F.col("next_route").alias("route_id"),
        F.concat("legs", F.array(leg("transit", F.col("mode"), F.col("next_route"), F.col("line"),
                                     F.col("board_id"), F.col("alight_id"), F.col("ride")))).alias("legs"),
        F.concat("seen", F.array("alight_id")).alias("seen"), sig.alias("signature"),
        (F.col("transit_minutes") + F.col("ride")).alias("transit_minutes"), "walk_minutes",
        (F.col("cost") + F.col("ride")).alias("cost"), *more)


def _fresh() -> Column:
    return (F.col("route_id").isNull() | (F.col("route_id") != F.col("next_route"))) & ~F.array_contains("seen", F.col("alight_id"))


def _with_changes(asked: DataFrame, start: DataFrame, out: DataFrame, paced: DataFrame, ride: DataFrame, walks: DataFrame,
                  found: DataFrame, k: int, max_transfers: int) -> DataFrame:
    """Itineraries of the `asked` pairs with one change or more that cost no more than the limit of their pair, if they have one."""
    asked = save_table(asked.select("od_id", "begin", (F.col("limit") - F.col("change") - F.col("finish")).alias("most_rode"),
                                    (F.col("limit") - F.col("finish")).alias("most_board"),
                                    (F.col("limit") - F.col("begin") - F.col("change")).alias("most_last")), "limits")
    factor, cols = F.col("factor"), [c for c in start.columns]
    # rides to an exit of the pair, which the last ride is met from on (pair, boarding stop)
    leave = save_table(out.select("od_id", F.col("stop_id").alias("alight_id"), "exit_walk").join(paced, "od_id").join(asked, "od_id").select(
        "od_id", "period", "alight_id", F.when(F.col("most_last").isNull(), None).otherwise(F.col("most_last") - F.col("exit_walk") * factor).alias("most")
    ).groupBy("od_id", "period", "alight_id").agg(F.max("most").alias("most")).where("most is null or most >= 0"), "leaving")
    to_exit = save_table(ride.join(leave, ["period", "alight_id"]).where(_within(F.col("ride"), F.col("most"))).withColumnRenamed(
        "board_id", "stop_id").drop("period", "most"), "to-exit")
    goals = save_table(to_exit.select("od_id", "stop_id").distinct(), "goals")
    done, known = [], found.select("od_id", "signature", "total")
    board = start.join(asked.select("od_id", "most_rode"), "od_id", "left_semi")
    for n in range(1, max_transfers + 1):
        ends_here = n == max_transfers
        board = board.join(asked.select("od_id", "most_rode", "most_board"), "od_id").where(_within(F.col("cost"), F.col("most_rode")))
        board = save_table(board.withColumn("from_label", F.monotonically_increasing_id()), f"board-{n}")
        # rides are laid out narrow; before the last change only labels from where a last ride can be reached are made whole
        hop = board.select("from_label", "od_id", "period", "route_id", "seen", "cost", "most_rode", F.col("stop_id").alias("board_id")).join(
            ride, ["period", "board_id"]).where(_fresh() & _within(F.col("cost") + F.col("ride"), F.col("most_rode"))).select(
            "from_label", "od_id", "period", "next_route", "mode", "line", "board_id", "alight_id", "ride")
        hop = save_table(hop.withColumn("label", F.monotonically_increasing_id()), f"rides-{n}")
        steps = None
        if ends_here:
            steps = save_table(_reaching(hop.select("label", "od_id", "period", F.col("alight_id").alias("stop_id")), goals, walks), "reaching")
            hop = hop.join(steps.select("label").distinct().hint("merge"), "label", "left_semi")
        rode = _rode(hop.drop("od_id", "period").join(board.hint("merge"), "from_label"), "label", "most_board")
        rode = save_table(_keep_best(rode, k, known), f"round-{n}")
        stay, move = rode, None
        if ends_here:
            stay = rode.join(steps.where("stay").hint("merge"), "label", "left_semi")
            move = rode.join(steps.where("not stay").select("label", "to_id", "w").hint("merge"), "label")
        else:
            move = rode.join(walks.select("period", F.col("from_id").alias("stop_id"), "to_id", F.col("minutes").alias("w")), ["period", "stop_id"])
        stay = stay.select(
            "od_id", "period", "factor", "stop_id", "route_id",
            F.concat("legs", F.array(_walk(F.col("stop_id"), F.col("stop_id"), F.lit(TRANSFER_MINUTES)))).alias("legs"),
            "seen", "signature", "transit_minutes", (F.col("walk_minutes") + TRANSFER_MINUTES).alias("walk_minutes"),
            (F.col("cost") + TRANSFER_MINUTES * factor + TRANSFER_MINUTES).alias("cost"), "most_board")
        move = move.where(~F.array_contains("seen", F.col("to_id"))).select(
            "od_id", "period", "factor", F.col("to_id").alias("stop_id"), "route_id",
            F.concat("legs", F.array(_walk(F.col("stop_id"), F.col("to_id"), F.col("w")))).alias("legs"),
            F.concat("seen", F.array("to_id")).alias("seen"), "signature", "transit_minutes",
            (F.col("walk_minutes") + F.col("w")).alias("walk_minutes"),
            (F.col("cost") + F.col("w") * factor + TRANSFER_MINUTES).alias("cost"), "most_board")
        board = stay.unionByName(move).where(_within(F.col("cost"), F.col("most_board"))).select(*cols)
        board = _keep_best(board, k, known)
        if not ends_here:
            board = save_table(board, f"changed-{n}")
        hop = board.join(to_exit, ["od_id", "stop_id"]).withColumn("board_id", F.col("stop_id"))
        done.append(_finish(_rode(hop), out, n))
        if not ends_here:
            done[-1] = save_table(done[-1], f"found-{n}")
            known = known.unionByName(done[-1].select(*known.columns))
    return _union(done)


def _reaching(labels: DataFrame, goals: DataFrame, walks: DataFrame) -> DataFrame:
    """(label, to_id, w, stay): the goals of its pair that a label stands at or can walk to.

    `labels`: label, od_id, period, stop_id; `goals`: od_id, stop_id. A label has
    many walks and few of them lead to a goal, so where labels are many they are dealt
    by pair and the walks between stops come to them; walks are never laid out over the wire.
    """
    net = walks.select("period", F.col("from_id").alias("stop_id"), "to_id", F.col("minutes").alias("w"))
    n = labels.count()
    if n <= LABELS_JOINED or net.count() > WALKS_AT_ONCE:
        here = labels.join(goals.hint("merge"), ["od_id", "stop_id"], "left_semi").select(
            "label", F.col("stop_id").alias("to_id"), F.lit(None).cast("double").alias("w"), F.lit(True).alias("stay"))
        away = labels.join(net, ["period", "stop_id"]).join(goals.withColumnRenamed("stop_id", "to_id").hint("merge"), ["od_id", "to_id"], "left_semi").select(
            "label", "to_id", F.col("w").cast("double").alias("w"), F.lit(False).alias("stay"))
        return here.unionByName(away)
    spark = labels.sparkSession
    net = net.where("period is not null and stop_id is not null and to_id is not null")
    number = lambda t, name: t.append_column(name, pa.array(range(len(t)), pa.int32()))
    begins, ends = number(net.select("period", "stop_id").distinct().toArrow(), "b"), number(net.select("to_id").distinct().toArrow(), "e")
    coded = net.join(spark.createDataFrame(begins), ["period", "stop_id"]).join(spark.createDataFrame(ends), "to_id").select(
        "b", "e", F.col("w").cast("double").alias("w")).toArrow()
    walk_map = spark.sparkContext.broadcast(WalkMap(begins, ends, coded))
    groups = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // LABELS_A_GROUP))
    group = F.pmod(F.xxhash64("od_id"), F.lit(groups)).alias("_g")
    own = labels.select(group, "label", "od_id", "period", "stop_id").groupBy("_g")
    return own.cogroup(goals.select(group, "od_id", "stop_id").groupBy("_g")).applyInArrow(
        lambda a, b: walk_map.value.reaching(a, b), "label long, to_id string, w double, stay boolean")


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _finish(labels: DataFrame, out: DataFrame, transfers: int) -> DataFrame:
    return labels.join(out, ["od_id", "stop_id"]).select(
        "od_id", "signature", F.lit(transfers).alias("transfers"), "transit_minutes",
        (F.col("walk_minutes") + F.col("exit_walk")).alias("walk_minutes"),
        (F.col("cost") + F.col("exit_walk") * F.col("factor")).alias("total"),
        F.concat("legs", F.array(_walk(F.col("stop_id"), "destination", F.col("exit_walk")))).alias("legs"))


def distinct_itineraries(itins: DataFrame) -> DataFrame:
    """The cheapest per (pair, transit signature); walking only has the empty one."""
    w = Window.partitionBy("od_id", "signature").orderBy("total", "walk_minutes", F.to_json("legs"))
    return itins.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


# --- totals and ranking ---------------------------------------------------------------


def route_total(transit: Column, walk: Column, first_wait: Column, waits: Column | None,
                transfers: Column, factor: Column | float = 1.0) -> Column:
    """ride + walk * factor + first wait + live or three-minute wait per transfer.

    `waits`: array with one nullable entry per later transit leg.
    """
    f = factor if isinstance(factor, Column) else F.lit(factor)
    base = transit + walk * f + first_wait
    flat = transfers * F.lit(TRANSFER_MINUTES)
    if waits is None:
        return base + flat
    heads = F.slice(waits, 1, F.greatest(transfers, F.lit(0)))
    live = F.aggregate(heads, F.lit(0.0), lambda a, w: a + F.coalesce(w.cast("double"), F.lit(TRANSFER_MINUTES)))
    missing = F.greatest(transfers - F.size(heads), F.lit(0)) * F.lit(TRANSFER_MINUTES)
    return base + F.coalesce(live + missing, flat)


def rank_itineraries(itins: DataFrame, waits: DataFrame | None = None, k: int = TOP_K,
                     walk_factor: float = 1.0) -> DataFrame:
    """Adds `rank` 1..k by total; with live waits the totals are formed anew.

    `waits`: od_id, signature, first_wait (minutes from now, may be null),
    transfer_waits (array). The walk to the first stop overlaps the first wait.
    """
    d = itins
    if waits is not None:
        d = d.join(waits, ["od_id", "signature"], "left")
        access = F.when(F.get("legs", F.lit(0))["from_id"] == "origin", F.get("legs", F.lit(0))["minutes"])
        stand = F.coalesce(F.greatest(F.col("first_wait") - F.coalesce(access, F.lit(0.0)), F.lit(0.0)), F.lit(0.0))
        d = d.withColumn("total", route_total(
            F.col("transit_minutes"), F.col("walk_minutes"), stand, F.col("transfer_waits"),
            F.col("transfers"), walk_factor)).drop("transfer_waits")
    w = Window.partitionBy("od_id").orderBy("total", "signature")
    return d.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def merge_itineraries(a: DataFrame, b: DataFrame, k: int = TOP_K) -> DataFrame:
    """The k best of two searches."""
    cols = ["od_id", "signature", "transfers", "transit_minutes", "walk_minutes", "total", "legs"]
    return rank_itineraries(a.select(*cols).unionByName(b.select(*cols)), k=k)


def final_status(status: DataFrame, itins: DataFrame) -> DataFrame:
    """ok when anything was found; else the coverage status or no_path."""
    found = itins.select("od_id").distinct().withColumn("_f", F.lit(True))
    j = status.join(found, "od_id", "left")
    ok = F.col("_f").isNotNull()
    return j.select(
        "od_id", F.when(ok, "ok").when(F.col("status") == "ok", "no_path").otherwise(F.col("status")).alias("status"),
        F.when(~ok, F.col("side")).alias("side"), F.when(~ok, F.lit(MAX_RADIUS)).alias("max_radius"))


def scale_walks(itins: DataFrame, speed: float) -> DataFrame:
    """Walk legs at another pace, one decimal each, and their new sum."""
    if speed == 1.0:
        return itins
    scaled = F.transform("legs", lambda x: F.when(
        x["leg_type"] == "walk", x.withField("minutes", F.round(x["minutes"] / speed, 1))).otherwise(x))
    total = F.aggregate(F.filter(scaled, lambda x: x["leg_type"] == "walk"), F.lit(0.0), lambda a, x: a + x["minutes"])
    return itins.withColumn("walk_minutes", F.round(total, 1)).withColumn("legs", scaled)


def filter_mode(itins: DataFrame, mode: str) -> DataFrame:
    """`Bus` drops itineraries with any rail leg."""
    if mode != "Bus":
        return itins
    rail = F.exists("legs", lambda x: (x["leg_type"] == "transit") & (
        (x["mode"] == "rail") | F.coalesce(x["route_id"].isin(list(LINE_NAMES)), F.lit(False))))
    return itins.where(~rail)


def leg_rows(itins: DataFrame) -> DataFrame:
    """Long form: one row per leg."""
    return itins.select("od_id", F.col("signature").alias("itin_id"),
                        F.posexplode("legs").alias("leg_no", "leg")).select("od_id", "itin_id", "leg_no", "leg.*")


def lines_used(legs: DataFrame) -> DataFrame:
    """Distinct lines per itinerary in order of first use; a bus is known by its code."""
    t = legs.where(F.col("leg_type") == "transit")
    key = F.when(F.col("mode") == "bus", F.concat(F.lit("bus:"), F.col("route_id"))).otherwise(F.col("line"))
    first = t.groupBy("od_id", "itin_id", key.alias("line_key")).agg(F.min("leg_no").alias("first_leg"))
    return first.groupBy("od_id", "itin_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("first_leg", "line_key"))), lambda x: x["line_key"]).alias("lines"))


def transfer_points(legs: DataFrame, ends: DataFrame | None = None) -> DataFrame:
    """Where consecutive legs meet: kind, place, and a connector for 9-120 m gaps.

    `legs` as rows with from/to coordinates; `ends`: od_id, o_lat, o_lon, d_lat,
    d_lon suppress walk changes at the trip's own ends.
    """
    w = Window.partitionBy("od_id", "itin_id").orderBy("leg_no")
    nxt = lambda c: F.lead(c).over(w)
    j = legs.select(
        "od_id", "itin_id", "leg_no", "leg_type", "mode", "to_lat", "to_lon", nxt("leg_type").alias("b_type"),
        nxt("mode").alias("b_mode"), nxt("from_lat").alias("b_lat"), nxt("from_lon").alias("b_lon"))
    a_t, b_t = F.col("leg_type") == "transit", F.col("b_type") == "transit"
    both_rail = (F.col("mode") == "rail") & (F.col("b_mode") == "rail")
    no_rail = (F.col("mode") != "rail") & (F.col("b_mode") != "rail")
    kind = (
        F.when(~a_t & b_t, "walk-transit").when(a_t & (F.col("b_type") == "walk"), "transit-walk")
        .when(a_t & b_t & both_rail, "rail-rail").when(a_t & b_t & no_rail, "bus-bus").when(a_t & b_t, "rail-bus"))
    lat = F.when(kind == "walk-transit", F.col("b_lat")).otherwise(F.coalesce("to_lat", "b_lat"))
    lon = F.when(kind == "walk-transit", F.col("b_lon")).otherwise(F.coalesce("to_lon", "b_lon"))
    gap = geo.haversine_metres(F.col("to_lat"), F.col("to_lon"), F.col("b_lat"), F.col("b_lon"))
    link = F.coalesce(a_t & b_t & (gap > SAME_CORNER_M) & (gap <= ONE_BLOCK_M), F.lit(False))
    out = j.select("od_id", "itin_id", "leg_no", kind.alias("kind"), lat.alias("lat"), lon.alias("lon"),
                   link.alias("connector")).where(F.col("kind").isNotNull() & F.col("lat").isNotNull())
    if ends is None:
        return out
    near = lambda a, b: F.coalesce(geo.haversine_metres(F.col("lat"), F.col("lon"), F.col(a), F.col(b)) <= SAME_CORNER_M, F.lit(False))
    own = F.col("kind").isin("walk-transit", "transit-walk") & (near("o_lat", "o_lon") | near("d_lat", "d_lon"))
    return out.join(ends, "od_id", "left").where(~own).select(*out.columns)


# --- legs of a node path ----------------------------------------------------------------


def legs_from_path(path_edges: DataFrame) -> DataFrame:
    """Edges of a path grouped into legs, line by line.

    `path_edges`: path_id, edge_no, from_id, to_id, edge_type, route_id, line,
    minutes, all_routes. A shared-track edge continues the line ridden so far
    when it serves it. A change of line at one stop inserts a three-minute
    platform leg. The state of the fold is the list of legs; a path is a
    simple path of the network and so short.
    """
    def last_ride(legs: Column) -> Column:
        rides = F.filter(legs, lambda x: x["leg_type"] == "transit")
        return F.try_element_at(rides, F.lit(-1))

    def other(e: Column, code: Column) -> Column:
        return F.get(F.filter(e["all_routes"], lambda r: r["route_id"] == code), F.lit(0))

    def step(legs: Column, e: Column) -> Column:
        prev = F.try_element_at(legs, F.lit(-1))
        walk = F.concat(legs, F.array(_walk(e["from_id"], e["to_id"], e["minutes"])))
        riding = F.coalesce(prev["leg_type"] == "transit", F.lit(False))
        serves = F.coalesce((e["route_id"] == prev["route_id"]) | other(e, prev["route_id"]).isNotNull(), F.lit(False))
        longer = prev.withField("to_id", e["to_id"]).withField("minutes", prev["minutes"] + e["minutes"])
        extended = F.concat(F.slice(legs, F.lit(1), F.greatest(F.size(legs) - 1, F.lit(0))), F.array(longer))
        came = last_ride(legs)["route_id"]
        alt = F.when(came != e["route_id"], other(e, came))
        code = F.coalesce(alt["route_id"], e["route_id"])
        name = F.when(alt.isNotNull(), alt["line"]).otherwise(e["line"])
        ride = leg("transit", e["mode"], code, name, e["from_id"], e["to_id"], e["minutes"])
        platform = _walk(e["from_id"], e["from_id"], F.lit(TRANSFER_MINUTES))
        meets = riding & (prev["to_id"] == e["from_id"])
        fresh = F.when(meets, F.concat(legs, F.array(platform, ride))).otherwise(F.concat(legs, F.array(ride)))
        return F.when(e["edge_type"] != "transit", walk).when(riding & serves, extended).otherwise(fresh)

    cols = ["edge_no", "from_id", "to_id", "edge_type", "mode", "route_id", "line", "minutes"]
    per_path = path_edges.groupBy("path_id").agg(F.sort_array(F.collect_list(F.struct(*cols, "all_routes"))).alias("edges"))
    fold = F.aggregate("edges", F.array().cast(f"array<{LEG}>"), step)
    return per_path.select("path_id", F.posexplode(fold).alias("leg_no", "leg")).select("path_id", "leg_no", "leg.*")


# --- bus to bus ---------------------------------------------------------------------------


def suffix_nearest(sequences: DataFrame) -> DataFrame:
    """For every stop of a sequence the nearest later-or-same stop to the destination.

    `sequences`: seq_id, pos, miles (to the destination); ties go to the later stop.
    """
    w = Window.partitionBy("seq_id").orderBy("pos").rowsBetween(0, Window.unboundedFollowing)
    best = F.min(F.struct("miles", (-F.col("pos")).alias("p"))).over(w)
    return sequences.withColumn("_b", best).select(
        *sequences.columns, (-F.col("_b.p")).alias("best_pos"), F.col("_b.miles").alias("best_miles"))


def bus_hops(seq: DataFrame, when: list[str]) -> DataFrame:
    """Every ride of a bus from a call to a later one, written once; no pair is needed for it.

    `hop` numbers rides by boarding stop, line and place of the exit, as ties of the score
    are broken; `line` and `call` number the sequences and boarding calls, `later` the exits of a
    call from the last one back.
    """
    line = [*when, "route_b", "dir_b"]
    calls = seq.select(*when, F.col("route_id").alias("route_b"), F.col("direction_id").alias("dir_b"), "pos", "stop_id", "arr_min").where(
        "route_b is not null and dir_b is not null").distinct()
    calls = save_table(calls.withColumn("call", F.monotonically_increasing_id()), "bus-calls")
    calls = calls.withColumn("line", F.min("call").over(Window.partitionBy(*line)))
    at = lambda p: calls.select("line", F.col("pos").alias(f"{p}_pos"), F.col("stop_id").alias(f"{p}_stop"), F.col("arr_min").alias(f"{p}_min"))
    start = calls.select(*line, "line", "call", F.col("pos").alias("t_pos"), F.col("stop_id").alias("t_stop"), F.col("arr_min").alias("t_min"))
    later = F.row_number().over(Window.partitionBy("call").orderBy(F.desc("exit_pos"), "exit_stop", "exit_min"))
    hops = start.join(at("exit"), "line").where("t_pos < exit_pos").withColumn("later", later)
    return save_table(hops.orderBy("t_stop", "route_b", "dir_b", "exit_pos").withColumn("hop", F.monotonically_increasing_id()), "bus-hops")


def _least(met: DataFrame, by: list[str], k: int) -> DataFrame:
    """The k least by (away, hop) of each group, with their number `n`; also those that rounding of a score may tie with them."""
    ranked = met.withColumn("n", F.row_number().over(Window.partitionBy(*by).orderBy("away", "hop"))).withColumn(
        "_same", F.row_number().over(Window.partitionBy(*by, "away").orderBy("hop")))
    last = F.max(F.when(F.col("n") <= k, F.col("away"))).over(Window.partitionBy(*by))
    return ranked.withColumn("_last", last).where((F.col("_same") <= k) & (F.col("away") <= F.col("_last") + SCORE_SLACK)).drop("_same", "_last")


def _met_within(asked: DataFrame, exits: DataFrame, hops: DataFrame, near: DataFrame, when: list[str], reach: float) -> DataFrame:
    """Second buses of every (pair, place of leaving the first) whose two walks are `reach` miles at most, the best exit of a call."""
    on = exits.where(F.col("exit_miles") <= reach).join(
        hops.select(*when, "exit_stop", "t_stop", "line", "call", "later", "hop").hint("merge"), ["exit_stop", *when]).drop("exit_stop", *when)
    walk = asked.join(near.where(F.col("change_miles") <= reach).hint("merge"), "sk_stop")
    met = walk.join(on, ["od_id", "t_stop"]).where(F.col("change_miles") + F.col("exit_miles") <= reach).drop("t_stop")
    best = Window.partitionBy("od_id", "sk_stop", "call").orderBy("exit_miles", "later")
    met = met.withColumn("_b", F.row_number().over(best)).where("_b = 1").drop("_b", "call", "later")
    met = met.withColumn("away", (F.col("change_miles") + F.col("exit_miles")) * SCORE_PER_MILE)
    return _least(met, ["od_id", "sk_stop", "line"], PER_ARRIVAL)


def _second_buses(asked: DataFrame, exits: DataFrame, hops: DataFrame, near: DataFrame, when: list[str]) -> DataFrame:
    """For every (pair, place of leaving the first bus) the second buses that may be among the best of a first bus.

    The walk and wait before the first bus are the same for all of them, so the
    least of (change + exit) come first whatever the first bus is. It may not be
    met again, so twice as many are kept, at most PER_ARRIVAL a line. Where short walks
    have enough of them, no longer one can be better; the other places are tried at full reach.
    """
    short = save_table(_met_within(asked, exits, hops, near, when, SHORT_REACH), "second-short")
    sure = (F.col("n") <= PER_ARRIVAL) & (F.col("away") <= SHORT_REACH * SCORE_PER_MILE - SCORE_SLACK)
    settled = save_table(short.groupBy("od_id", "sk_stop").agg(F.count_if(sure).alias("sure")).where(
        F.col("sure") >= 2 * PER_ARRIVAL).select("od_id", "sk_stop"), "second-settled")
    left = save_table(asked.join(settled.hint("merge"), ["od_id", "sk_stop"], "left_anti"), "second-left")
    far = _met_within(left, exits.join(left.select("od_id").distinct(), "od_id", "left_semi"), hops, near, when,
                      MAX_EXIT_MILES + MAX_TRANSFER_MILES)
    met = short.join(settled.hint("merge"), ["od_id", "sk_stop"], "left_semi").unionByName(far).drop("n")
    few = _least(met, ["od_id", "sk_stop"], 2 * PER_ARRIVAL).drop("n", "away", "line")
    return few.join(hops.select("hop", "route_b", "dir_b", "t_pos", "t_stop", "t_min", "exit_pos", "exit_stop", "exit_min").hint("merge"), "hop").drop("hop")


def bus_bus(od: DataFrame, access: DataFrame, arrivals: DataFrame, sequences: DataFrame,
            n: int = 2, walk_factor: float = 1.0) -> DataFrame:
    """Two-bus itineraries with a walk of at most a quarter mile between the buses.

    `od`: od_id, d_lat, d_lon; `access`: od_id, stop_id, walk_minutes;
    `arrivals`: stop_id, line_code, minutes; `sequences`: route_id,
    direction_id, pos, stop_id, lat, lon, arr_min. The second bus is narrowed
    to lines with a stop near the destination before it meets the first. Where
    `sequences` has a period, a pair rides the buses of its own; where `od` has a
    walk_factor, it walks at its own pace. The rides of the second bus are laid out
    once for all pairs and meet only the places where a first bus of the pair can be left.
    """
    when = ["period"] if "period" in sequences.columns else []
    seq = sequences.select(*when, "route_id", "direction_id", "pos", "stop_id", "lat", "lon", "arr_min")
    pace = (F.col("walk_factor") if "walk_factor" in od.columns else F.lit(walk_factor)).cast("double").alias("pace")
    dest = od.select("od_id", F.col("d_lat").alias("lat"), F.col("d_lon").alias("lon"))
    place = seq.select("stop_id", "lat", "lon").groupBy("stop_id").agg(F.min(F.struct("lat", "lon")).alias("p")).select(
        "stop_id", "p.*")
    # first bus: boarded at a stop with a live arrival, left nearer to the destination
    first = (
        arrivals.groupBy("stop_id", F.col("line_code").alias("route_a")).agg(F.min("minutes").alias("wait"))
        .join(access.select("od_id", "stop_id", "walk_minutes"), "stop_id")
        .join(od.select("od_id", *when, "d_lat", "d_lon", pace), "od_id")
        .join(seq.select(*when, "stop_id", F.col("route_id").alias("route_a"), F.col("direction_id").alias("dir_a"),
                         F.col("pos").alias("board_pos"), F.col("arr_min").alias("board_min"), "lat", "lon"), ["stop_id", "route_a", *when]))
    hav = lambda: geo.haversine(F.col("lat"), F.col("lon"), F.col("d_lat"), F.col("d_lon"))
    first = first.withColumn("board_miles", hav()).drop("lat", "lon")
    fwd = first.join(seq.select(*when, F.col("route_id").alias("route_a"), F.col("direction_id").alias("dir_a"), F.col("pos").alias("sk_pos"),
                                F.col("stop_id").alias("sk_stop"), F.col("arr_min").alias("sk_min"), "lat", "lon"), ["route_a", "dir_a", *when])
    fwd = fwd.where((F.col("sk_pos") > F.col("board_pos")) & (hav() < F.col("board_miles") * FORWARD_RATIO)).drop("lat", "lon")
    fwd = save_table(fwd, "first-buses")
    # second bus: the few per place of leaving the first that the score can choose
    exits = radius_join(place, dest, MAX_EXIT_MILES).select("od_id", F.col("stop_id").alias("exit_stop"), F.col("miles").alias("exit_miles"))
    exits = save_table(exits.join(od.select("od_id", *when), "od_id"), "bus-exits")
    near = save_table(cell_pairs(
        place.select(F.col("stop_id").alias("sk_stop"), "lat", "lon"), place.select(F.col("stop_id").alias("t_stop"), "lat", "lon"),
        MAX_TRANSFER_MILES).select("sk_stop", "t_stop", F.col("miles").alias("change_miles")), "bus-changes")
    asked = save_table(fwd.select("od_id", "sk_stop").distinct(), "bus-places")
    second = _second_buses(asked, exits, bus_hops(seq, when), near, when)
    c = fwd.drop(*when).join(second, ["od_id", "sk_stop"]).where(
        (F.col("route_a") != F.col("route_b")) | (F.col("dir_a") != F.col("dir_b")))
    score = F.col("walk_minutes") + F.col("wait") + (F.col("change_miles") + F.col("exit_miles")) * SCORE_PER_MILE
    c = c.withColumn("score", score)
    order = Window.partitionBy("od_id", "stop_id", "route_a", "dir_a").orderBy("score", "sk_pos", "t_stop", "route_b", "dir_b", "exit_pos")
    top = c.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= PER_ARRIVAL)
    ident = ["od_id", "route_a", "dir_a", "sk_pos", "t_stop", "route_b", "dir_b", "exit_pos"]
    same = Window.partitionBy(*ident).orderBy("score", "stop_id")
    top = top.withColumn("_r", F.row_number().over(same)).where("_r = 1").drop("_r")
    # timed: both rides, the change, the last walk
    span = lambda a, b: F.when(F.col(b) < F.col(a), F.col(b) - F.col(a) + 1440).otherwise(F.col(b) - F.col(a))
    change = F.when(F.col("sk_stop") == F.col("t_stop"), 0.0).otherwise(
        F.greatest(F.round(geo.walk_minutes(F.col("change_miles")), 1), F.lit(TRANSFER_MINUTES)))
    t = top.withColumn("ride_a", span("board_min", "sk_min")).withColumn(
        "ride_b", span("t_min", "exit_min")).withColumn("change", change).withColumn(
        "exit_walk", F.round(geo.walk_minutes(F.col("exit_miles")), 1))
    walk = F.col("walk_minutes") + F.col("change") + F.col("exit_walk")
    t = t.where((F.col("ride_a") > 0) & (F.col("ride_b") > 0)).withColumn("walks", F.round(walk, 1)).withColumn(
        "total", F.col("ride_a") + F.col("ride_b") + walk * F.col("pace") + F.col("wait") + TRANSFER_MINUTES
    ).where(F.col("total") <= MAX_TRIP_MINUTES)
    exit_stop = F.col("exit_stop")
    legs = F.array(
        _walk("origin", F.col("stop_id"), F.round("walk_minutes", 1)),
        leg("transit", "bus", F.col("route_a"), F.col("route_a"), F.col("stop_id"), F.col("sk_stop"), F.round("ride_a", 1)),
        _walk(F.col("sk_stop"), F.col("t_stop"), F.round("change", 1)),
        leg("transit", "bus", F.col("route_b"), F.col("route_b"), F.col("t_stop"), exit_stop, F.round("ride_b", 1)),
        _walk(exit_stop, "destination", F.col("exit_walk")))
    sig = F.concat(F.col("route_a"), F.lit(":"), F.col("stop_id"), F.lit(">"), F.col("sk_stop"), F.lit("|"),
                   F.col("route_b"), F.lit(":"), F.col("t_stop"), F.lit(">"), exit_stop)
    res = t.select("od_id", sig.alias("signature"), F.lit(1).alias("transfers"),
                   F.round(F.col("ride_a") + F.col("ride_b"), 1).alias("transit_minutes"),
                   F.col("walks").alias("walk_minutes"), "total", "wait", legs.alias("legs"))
    return rank_itineraries(res, k=n)


# --- shapes ---------------------------------------------------------------------------------


def nearest_on_shape(spots: DataFrame, pts: DataFrame) -> DataFrame:
    """(shape_id, y, x, d, pos): the shape's point nearest each spot in squared degrees, the first of equal ones.

    A shape of n points is laid out in a grid with about sqrt(n) points in a cell
    at most. The nearest and farthest a cell's box can be rule out all cells but
    a few, so a spot meets those cells' points only.
    """
    size = F.greatest(F.max("lat") - F.min("lat"), F.max("lon") - F.min("lon"), F.lit(1e-9)) / F.greatest(
        F.sqrt(F.sqrt(F.count("*").cast("double"))), F.lit(1.0))
    grid = pts.groupBy("shape_id").agg(size.alias("size"))
    cell = [F.floor(F.col(c) / F.col("size")).alias(n) for c, n in (("lat", "cy"), ("lon", "cx"))]
    celled = pts.join(grid, "shape_id").select("shape_id", *cell, "lat", "lon", "pos")
    box = celled.groupBy("shape_id", "cy", "cx").agg(
        F.min("lat").alias("y0"), F.max("lat").alias("y1"), F.min("lon").alias("x0"), F.max("lon").alias("x1"))
    key = ["shape_id", "y", "x"]
    out = lambda v, a, b: F.greatest(F.col(a) - F.col(v), F.col(v) - F.col(b), F.lit(0.0))
    far = lambda v, a, b: F.greatest(F.abs(F.col(v) - F.col(a)), F.abs(F.col(v) - F.col(b)))
    near_box = (out("y", "y0", "y1") ** 2 + out("x", "x0", "x1") ** 2) * (1 - 1e-9)
    far_box = (far("y", "y0", "y1") ** 2 + far("x", "x0", "x1") ** 2) * (1 + 1e-9)
    met = spots.join(box, "shape_id")
    bound = met.groupBy(*key).agg(F.min(far_box).alias("bound"))
    near = met.withColumn("near", near_box).join(bound, key).where(F.col("near") <= F.col("bound")).select(*key, "cy", "cx", "near")
    near = save_table(near, "shape-cells")
    d = (F.col("lat") - F.col("y")) ** 2 + (F.col("lon") - F.col("x")) ** 2
    least = near.join(celled, ["shape_id", "cy", "cx"]).groupBy(*key).agg(F.min(d).alias("d"))
    last = near.join(least, key).where(F.col("near") <= F.col("d")).join(celled, ["shape_id", "cy", "cx"])
    return last.where(d == F.col("d")).groupBy(*key, "d").agg(F.min("pos").alias("pos"))


def clip_shape(legs: DataFrame, shapes: DataFrame, chosen: DataFrame) -> DataFrame:
    """Shape between the points nearest the two stops, at most 100 points, ends kept.

    `legs`: leg_id, route_key, direction_id, from/to coordinates; `shapes`:
    shape_id, seq, lat, lon; `chosen`: route_key, direction_id, shape_id. Only
    the sampled points are fetched; whole shapes are never gathered.
    """
    pts = shapes.groupBy("shape_id", "seq").agg(F.min(F.struct("lat", "lon")).alias("p")).select("shape_id", "seq", "p.*")
    pts = pts.withColumn("pos", F.row_number().over(Window.partitionBy("shape_id").orderBy("seq")) - 1)
    pts = save_table(pts, "shape-points")
    l = legs.join(chosen.select("route_key", "direction_id", "shape_id"), ["route_key", "direction_id"], "left")
    at = lambda a, b: F.struct(F.col(a).alias("y"), F.col(b).alias("x"))
    l = l.select("leg_id", "shape_id", at("from_lat", "from_lon").alias("f"), at("to_lat", "to_lon").alias("t"))
    spots = l.select("shape_id", F.inline(F.array("f", "t"))).distinct()
    found = save_table(nearest_on_shape(spots, pts), "shape-ends")
    end = lambda c, n: found.select("shape_id", at("y", "x").alias(c), F.struct("d", "pos").alias(n))
    ends = l.join(end("f", "a"), ["shape_id", "f"]).join(end("t", "b"), ["shape_id", "t"]).groupBy("leg_id", "shape_id").agg(
        F.min("a").alias("a"), F.min("b").alias("b"))
    lo, hi = F.least("a.pos", "b.pos"), F.greatest("a.pos", "b.pos")
    size, back = hi - lo + 1, F.col("a.pos") > F.col("b.pos")
    even = F.transform(F.sequence(F.lit(0), F.least(size, F.lit(SHAPE_POINTS)) - 1), lambda i: F.when(
        size <= SHAPE_POINTS, i).when(i == SHAPE_POINTS - 1, size - 1).otherwise(
        F.bround(i * ((size - 1) / F.lit(SHAPE_POINTS - 1.0))).cast("int")))
    want = ends.where(lo < hi).select("leg_id", "shape_id", F.posexplode(even).alias("point_no", "i"),
                                      F.when(back, hi).otherwise(lo).alias("start"), F.when(back, -1).otherwise(1).alias("dir"))
    cut = want.withColumn("pos", F.col("start") + F.col("dir") * F.col("i")).join(
        pts.select("shape_id", "pos", "lat", "lon"), ["shape_id", "pos"]).select("leg_id", "point_no", "lat", "lon")
    whole = ends.where(lo < hi).select("leg_id")
    line = F.array(F.struct(F.lit(0).alias("point_no"), F.col("from_lat").alias("lat"), F.col("from_lon").alias("lon")),
                   F.struct(F.lit(1).alias("point_no"), F.col("to_lat").alias("lat"), F.col("to_lon").alias("lon")))
    straight = legs.join(whole, "leg_id", "left_anti").select("leg_id", F.inline(line))
    r = lambda c: F.round(c, SHAPE_DECIMALS).alias(c)
    return cut.unionByName(straight).select("leg_id", "point_no", r("lat"), r("lon"))
