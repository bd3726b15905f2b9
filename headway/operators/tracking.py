"""Trip tracking over GPS pings.

Distances are Column arithmetic in a join of pings with the trip's legs; only
the walk along the legs, which depends on where the traveller already is,
carries state.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.timecode import epoch_us

# Radii in metres, quiet time after a reroute, trip lifetime.
ADVANCE_M, ADVANCE_VEHICLE_M = 60.0, 150.0
STEP_M, OFF_ROUTE_M = 30.0, 400.0
QUIET_US = 90 * 1_000_000
TRIP_HOURS = 4


def measured(pings: DataFrame, legs: DataFrame, *keep: str) -> DataFrame:
    """Each ping with its distance to every leg's end, walk path and walk steps.

    `pings`: trip_id, ts, lat, lon, on_vehicle, rerouted; `legs`: trip_id,
    leg_no, leg_type, path (lat/lon structs), steps (lat/lon structs). A trip
    has a handful of legs, kept in one array per trip for the static side of
    the join.
    """
    per_trip = legs.groupBy("trip_id").agg(F.array_sort(F.collect_list(
        F.struct("leg_no", "leg_type", "path", "steps"))).alias("legs"))
    lat, lon = F.col("lat"), F.col("lon")

    def one(g):
        end = F.try_element_at(g["path"], F.lit(-1))
        near = F.filter(
            F.transform(g["steps"], lambda s, i: F.struct(
                i.alias("i"), geo.haversine_metres(lat, lon, s["lat"], s["lon"]).alias("m"))),
            lambda s: s["m"] < STEP_M)
        return F.struct(
            g["leg_type"].alias("leg_type"), geo.haversine_metres(lat, lon, end["lat"], end["lon"]).alias("to_end"),
            geo.path_metres(lat, lon, g["path"]).alias("to_path"), F.transform(near, lambda s: s["i"]).alias("steps"))

    # a row of arrays is far wider than the column it was made from, so a size estimate would broadcast all legs
    return pings.join(per_trip.hint("merge"), "trip_id").select(
        "trip_id", *keep, epoch_us(F.col("ts")).alias("us"), "on_vehicle", "rerouted",
        F.transform("legs", one).alias("legs"))


@dataclass
class Trip:
    """What is known of a trip between two pings."""

    leg: int = 0
    done: set = field(default_factory=set)
    quiet_until: int = 0


def advance(trip: Trip, ping) -> dict:
    """Move to the next leg near the end of this one, mark steps, test the route.

    `ping` is a row of `measured`; its legs are rows or dicts.
    """
    legs, cleared = ping.legs, False
    if ping.rerouted:
        trip.quiet_until = ping.us + QUIET_US
    if trip.leg < len(legs):
        here = legs[trip.leg]
        reach = ADVANCE_VEHICLE_M if ping.on_vehicle and here["leg_type"] == "transit" else ADVANCE_M
        if here["to_end"] is not None and here["to_end"] < reach and trip.leg + 1 < len(legs):
            trip.leg += 1
            cleared = legs[trip.leg]["leg_type"] != "walk"
    added, off = [], None
    if trip.leg < len(legs) and legs[trip.leg]["leg_type"] == "walk":
        now = legs[trip.leg]
        near = [] if now["steps"] is None else now["steps"]
        added = [k for k in (f"{trip.leg}-{i}" for i in near) if k not in trip.done]
        trip.done.update(added)
        if ping.us > trip.quiet_until:
            off = now["to_path"] is None or now["to_path"] > OFF_ROUTE_M
    return {"leg": trip.leg, "new_steps": ",".join(added), "off_route": off, "cleared": cleared}


TRACK_SCHEMA = "trip_id long, us long, leg int, new_steps string, off_route boolean, cleared boolean"


def track_trips(pings: DataFrame, legs: DataFrame, gap_hours: int = TRIP_HOURS) -> DataFrame:
    """Batch twin: pings of a trip in order; progress is forgotten after the trip's lifetime."""
    def follow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, trip = None, Trip()
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                if (r.trip_id, r.part) != key:
                    key, trip = (r.trip_id, r.part), Trip()
                rows.append((r.trip_id, r.us, *advance(trip, r).values()))
            yield pd.DataFrame(rows, columns=["trip_id", "us", "leg", "new_steps", "off_route", "cleared"])

    # a pause longer than the lifetime starts afresh, so a trip is cut there; one
    # sorted pass per partition carries the state of one trip at a time
    w = Window.partitionBy("trip_id").orderBy("us")
    cut = F.coalesce((F.col("us") - F.lag("us").over(w) > gap_hours * 3_600_000_000).cast("int"), F.lit(1))
    at = pings.withColumn("us", epoch_us(F.col("ts"))).withColumn("_cut", cut).withColumn("part", F.sum("_cut").over(w))
    m = measured(at, legs, "part").repartition("trip_id", "part").sortWithinPartitions("trip_id", "part", "us")
    return m.mapInPandas(follow, TRACK_SCHEMA)
