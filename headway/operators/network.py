"""Transit network edges and rides from representative trips."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.timecode import PERIODS
from .schedule import line_name, to_parent
from .spatial import TRANSFER_MINUTES, intermodal_edges

# Longest plausible hop, shortest bus hop.
MAX_HOP_MINUTES = 45.0
BUS_HOP_FLOOR = 0.5
EDGE_COLUMNS = ["period", "from_id", "to_id", "minutes", "edge_type", "mode", "route_id",
                "direction_id", "line", "all_routes"]
ROUTES_TYPE = "array<struct<route_id:string,direction_id:string,line:string>>"


def rail_hops(rep_stops: DataFrame, stations: DataFrame) -> DataFrame:
    """Consecutive stations of rail representatives, all lines, plausible minutes only."""
    w = Window.partitionBy("period", "trip_id").orderBy("pos")
    hop = rep_stops.where(F.col("mode") == "rail").select(
        "period", "route_id", "direction_id", F.col("stop_id").alias("from_id"),
        F.lead("stop_id").over(w).alias("to_id"),
        (F.lead("arr_min").over(w) - F.col("arr_min")).alias("minutes"))
    ok = (F.col("from_id") != F.col("to_id")) & (F.col("minutes") > 0) & (
        F.col("minutes") <= MAX_HOP_MINUTES)
    known = stations.select("stop_id")
    return (
        hop.where(ok)
        .join(known, F.col("from_id") == known["stop_id"], "left_semi")
        .join(known, F.col("to_id") == known["stop_id"], "left_semi")
        .groupBy("period", "from_id", "to_id", "route_id")
        .agg(F.min(F.struct("minutes", "direction_id")).alias("m"))
        .select("period", "from_id", "to_id", "route_id", "m.minutes", "m.direction_id")
    )


def hop_edges(rep_stops: DataFrame, stops: DataFrame) -> DataFrame:
    """Rail: the fastest line per pair plus all its lines. Bus: one edge per route."""
    stations = stops.where(F.col("kind") == "station")
    entry = F.struct("route_id", "direction_id", line_name(F.col("route_id")).alias("line"))
    rail = (
        rail_hops(rep_stops, stations).groupBy("period", "from_id", "to_id")
        .agg(F.min(F.struct("minutes", "route_id", "direction_id")).alias("m"),
             F.array_sort(F.collect_list(entry)).alias("all_routes"))
        .select("period", "from_id", "to_id", "m.minutes", F.lit("transit").alias("edge_type"),
                F.lit("rail").alias("mode"), "m.route_id", "m.direction_id",
                line_name(F.col("m.route_id")).alias("line"),
                F.when(F.size("all_routes") > 1, F.col("all_routes")).alias("all_routes"))
    )
    place = stops.where(F.col("kind") == "bus").select("stop_id", "lat", "lon")
    w = Window.partitionBy("period", "trip_id").orderBy("pos")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    bus = rep_stops.where(F.col("mode") == "bus").join(place, "stop_id")
    bearing = geo.bearing(
        F.first("lat").over(whole), F.first("lon").over(whole),
        F.last("lat").over(whole), F.last("lon").over(whole))
    bus = bus.select(
        "period", F.col("stop_id").alias("from_id"), F.lead("stop_id").over(w).alias("to_id"),
        F.greatest(F.lead("arr_min").over(w) - F.col("arr_min"), F.lit(BUS_HOP_FLOOR)).alias("minutes"),
        F.lit("transit").alias("edge_type"), F.lit("bus").alias("mode"), "route_id", "direction_id",
        geo.cardinal(bearing).alias("line"), F.lit(None).cast(ROUTES_TYPE).alias("all_routes"),
    ).where(F.col("to_id").isNotNull())
    return rail.select(*EDGE_COLUMNS).unionByName(bus.select(*EDGE_COLUMNS))


def transfer_edges(transfers: DataFrame, stops: DataFrame) -> DataFrame:
    """Station-to-station transfers of at least three minutes, both directions."""
    t = to_parent(to_parent(transfers, stops, "from_id"), stops, "to_id")
    known = stops.where(F.col("kind") == "station").select("stop_id")
    t = (
        t.where(F.col("from_id") != F.col("to_id"))
        .join(known, F.col("from_id") == known["stop_id"], "left_semi")
        .join(known, F.col("to_id") == known["stop_id"], "left_semi")
        .withColumn("minutes", F.greatest(F.col("seconds") / 60.0, F.lit(TRANSFER_MINUTES)))
    )
    both = F.array(F.struct(F.col("from_id"), F.col("to_id")),
                   F.struct(F.col("to_id").alias("from_id"), F.col("from_id").alias("to_id")))
    return t.select("minutes", F.inline(both)).groupBy("from_id", "to_id").agg(
        F.min("minutes").alias("minutes"))


def network_edges(rep_stops: DataFrame, stops: DataFrame, transfers: DataFrame) -> DataFrame:
    """Per period: hops, transfers where no hop exists, walks between rail and bus."""
    hops = hop_edges(rep_stops, stops)
    served = rep_stops.select("period").distinct()
    names = F.array(*[F.lit(p[0]) for p in PERIODS])
    none = F.lit(None).cast("string")
    plain = lambda df, kind: df.withColumn("period", F.explode(names)).join(
        served, "period", "left_semi").select(
        "period", "from_id", "to_id", "minutes", F.lit(kind).alias("edge_type"),
        F.lit("walk" if kind == "walk" else "rail").alias("mode"), F.lit(kind).alias("route_id"),
        none.alias("direction_id"), F.lit(kind).alias("line"),
        F.lit(None).cast(ROUTES_TYPE).alias("all_routes"))
    transfer = plain(transfer_edges(transfers, stops), "transfer").join(
        hops.select("period", "from_id", "to_id"), ["period", "from_id", "to_id"], "left_anti")
    walk = plain(intermodal_edges(stops.where(F.col("kind") == "station"),
                                  stops.where(F.col("kind") == "bus")), "walk")
    return hops.unionByName(transfer).unionByName(walk)


def rides(rep_stops: DataFrame) -> DataFrame:
    """Every (board, alight) pair on a representative trip with its minutes.

    Only the one representative per (period, route, direction) is expanded and
    a trip is bounded by its sequence numbers, so the output stays near the
    size of the timetable.
    """
    a = rep_stops.select("period", "trip_id", "route_id", "direction_id", "mode",
                         F.col("stop_id").alias("board_id"), F.col("pos").alias("board_pos"),
                         F.col("arr_min").alias("board_min"))
    b = rep_stops.select("period", "trip_id", F.col("stop_id").alias("alight_id"),
                         F.col("pos").alias("alight_pos"), F.col("arr_min").alias("alight_min"))
    m = F.col("alight_min") - F.col("board_min")
    return (
        a.join(b, ["period", "trip_id"])
        .where((F.col("board_pos") < F.col("alight_pos")) & (F.col("board_id") != F.col("alight_id")))
        .withColumn("minutes", F.when(m < 0, m + 1440).otherwise(m)).where(F.col("minutes") > 0)
        .drop("board_min", "alight_min", "trip_id")
    )
