"""Trip planning for a table of origin-destination pairs, end to end."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import weather
from ..functions.timecode import service_period
from ..operators import itinerary as I
from ..operators import live as V
from ..operators import network as N
from ..session import save_table
from .feed import Feed


@dataclass
class TripNetwork:
    """Tables every search reads: stops, edges, rides, walks between stops."""

    stops: DataFrame
    edges: DataFrame
    rides: DataFrame
    walks: DataFrame

    @classmethod
    def build(cls, feed: Feed) -> TripNetwork:
        stops = save_table(feed.stops, "stops")
        edges = save_table(N.network_edges(feed.rep_stops, stops, feed.tables["transfers"]), "edges")
        rides = save_table(N.rides(feed.rep_stops).withColumn("line", F.col("route_id")), "rides")
        walks = edges.where(F.col("edge_type").isin("walk", "transfer")).select(
            "period", "from_id", "to_id", "minutes")
        return cls(stops, edges, rides, walks)


def weather_pace(od: DataFrame, forecasts: DataFrame, lat: str = "o_lat", lon: str = "o_lon", ts: str = "depart") -> DataFrame:
    """`od` with walk_factor: how much longer its walks take in the weather where and when it starts.

    `forecasts`: lat, lon, ts, precipitation, intensity, gust, feels_like. A trip
    without a fresh forecast walks at the usual pace.
    """
    at = od.select(F.struct(*od.columns).alias("_od"), F.col(lat).alias("lat"), F.col(lon).alias("lon"), F.col(ts).alias("ts"))
    now = V.weather_asof(at, forecasts)
    f = F.col("forecast")
    speed = weather.walk_factor(f["precipitation"], f["intensity"], f["gust"], f["feels_like"])
    return now.select("_od.*", F.coalesce(F.when(f.isNotNull(), 1 / speed), F.lit(1.0)).alias("walk_factor"))


def plan_trips(od: DataFrame, net: TripNetwork, k: int = I.TOP_K, walk_factor: float = 1.0,
               arrivals: DataFrame | None = None, sequences: DataFrame | None = None):
    """(itineraries, status) of `od`: od_id, o_lat, o_lon, d_lat, d_lon, depart (local) and, if known, walk_factor.

    Pairs that ask for the same trip in the same period at the same pace are
    searched once. `sequences` with a period serve the pairs of that period.
    """
    trip = ["o_lat", "o_lon", "d_lat", "d_lon", "period", *(["walk_factor"] if "walk_factor" in od.columns else [])]
    asked = od.withColumn("period", service_period(F.col("depart")))
    unique = save_table(asked.groupBy(*trip).agg(F.min("od_id").alias("od_id")), "pairs")
    lines = I.serving_lines(net.edges)
    at = lambda p: unique.select("od_id", F.col(f"{p}_lat").alias("lat"), F.col(f"{p}_lon").alias("lon"))
    access = save_table(I.access_stops(at("o"), net.stops, lines), "access")
    egress = save_table(I.access_stops(at("d"), net.stops, lines), "egress")
    status = I.coverage_status(unique, access, egress)
    inside = unique.join(status.where(F.col("status") == "ok").select("od_id"), "od_id", "left_semi")
    found = I.itineraries(inside, access, egress, net.rides, net.walks, k, walk_factor=walk_factor)
    if arrivals is not None and sequences is not None:
        buses = I.bus_bus(unique, access.where(F.col("mode") == "bus"), arrivals, sequences, walk_factor=walk_factor)
        found = I.merge_itineraries(found, buses, k)
    status = I.final_status(status, found)
    back = asked.select(F.col("od_id").alias("asked_id"), *trip).join(unique, trip).select("asked_id", "od_id")
    spread = lambda df: back.join(df, "od_id").drop("od_id").withColumnRenamed("asked_id", "od_id")
    return spread(found), spread(status)
