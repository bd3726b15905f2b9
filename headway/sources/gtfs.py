"""Schedule feed reader: text columns in, typed tables and rejects out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.timecode import clock_parts, hhmm_of, minutes_of
from ..session import settle

# The columns of each feed table and whether the file is optional.
FEED_COLUMNS = {
    "stops": ["stop_id", "stop_name", "stop_lat", "stop_lon", "location_type", "parent_station"],
    "routes": ["route_id", "route_short_name", "route_long_name", "route_type", "route_color"],
    "trips": ["route_id", "service_id", "trip_id", "direction_id", "shape_id", "trip_headsign"],
    "stop_times": ["trip_id", "arrival_time", "departure_time", "stop_id", "stop_sequence",
                   "stop_headsign"],
    "transfers": ["from_stop_id", "to_stop_id", "transfer_type", "min_transfer_time"],
    "shapes": ["shape_id", "shape_pt_lat", "shape_pt_lon", "shape_pt_sequence"],
    "calendar": ["service_id", "monday", "tuesday", "wednesday", "thursday", "friday",
                 "saturday", "sunday", "start_date", "end_date"],
    "calendar_dates": ["service_id", "date", "exception_type"],
}
OPTIONAL = {"transfers", "shapes", "calendar", "calendar_dates"}


def _exists(spark: SparkSession, path: str) -> bool:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.exists(jpath)


def read_raw(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The feed's CSV files as trimmed text; an absent optional file is empty.

    Columns are matched by header name, so order and extra columns are free.
    """
    out = {}
    for name, cols in FEED_COLUMNS.items():
        path = f"{folder}/{name}.txt"
        schema = ", ".join(f"{c} string" for c in cols)
        if name in OPTIONAL and not _exists(spark, path):
            out[name] = spark.createDataFrame([], schema)
            continue
        raw = spark.read.option("header", True).csv(path)
        have = {c.strip("﻿").strip(): c for c in raw.columns}
        out[name] = raw.select(*[
            F.trim(F.col(f"`{have[c]}`")).alias(c) if c in have
            else F.lit(None).cast("string").alias(c)
            for c in cols
        ])
    return out


def _text(c: str) -> Column:
    return F.trim(F.coalesce(F.col(c), F.lit("")))


def _or(c: str, default: str) -> Column:
    return F.coalesce(F.nullif(_text(c), F.lit("")), F.lit(default))


def _day(c: str) -> Column:
    return F.try_to_date(_text(c), "yyyyMMdd")


def coerce(raw: dict[str, DataFrame]) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """Typed tables and, per table, the raw rows that did not convert."""
    good: dict[str, DataFrame] = {}
    bad: dict[str, DataFrame] = {}

    def split(name: str, df: DataFrame, ok: Column, *cols: Column) -> None:
        flagged = df.withColumn("_ok", F.coalesce(ok, F.lit(False)))
        good[name] = flagged.where("_ok").select(*cols)
        bad[name] = flagged.where("NOT _ok").drop("_ok")

    stops = settle(raw["stops"], F.col("stop_id").try_cast("bigint").alias("_n"), F.col("stop_lat").try_cast("double").alias("_lat"),
                   F.col("stop_lon").try_cast("double").alias("_lon"), _text("stop_id").alias("_id"), _text("parent_station").alias("_parent"))
    split("stops", stops, F.col("_n").isNotNull() & F.col("_lat").isNotNull() & F.col("_lon").isNotNull(),
          F.col("_id").alias("stop_id"), _text("stop_name").alias("name"),
          F.col("_lat").alias("lat"), F.col("_lon").alias("lon"), _text("location_type").alias("location_type"),
          F.nullif("_parent", F.lit("")).alias("parent_id"))
    bad["stops"] = bad["stops"].drop("_n", "_lat", "_lon", "_id", "_parent")
    split("routes", raw["routes"], _text("route_id") != "",
          _text("route_id").alias("route_id"), _text("route_short_name").alias("short_name"),
          _text("route_long_name").alias("long_name"), _text("route_type").alias("route_type"),
          F.lower(_text("route_color")).alias("color"))
    split("trips", raw["trips"], _text("trip_id") != "",
          _text("trip_id").alias("trip_id"), _text("route_id").alias("route_id"),
          _text("service_id").alias("service_id"), _or("direction_id", "0").alias("direction_id"),
          F.nullif(_text("shape_id"), F.lit("")).alias("shape_id"),
          _text("trip_headsign").alias("headsign"))
    # texts, then their pieces, then numbers: each stage computed once per row, also for the filters of later jobs
    st = settle(raw["stop_times"], _text("arrival_time").alias("_at"), _text("departure_time").alias("_dt"))
    first = lambda a, b: F.when(F.col(a) != "", F.col(a)).when(F.col(b) != "", F.col(b))
    st = settle(st, first("_at", "_dt").alias("_arr"), first("_dt", "_at").alias("_dep"))
    st = settle(st, clock_parts(F.col("_arr")).alias("_a"), clock_parts(F.col("_dep")).alias("_d"))
    st = settle(st, minutes_of(F.col("_a")).alias("_arr_min"), minutes_of(F.col("_d")).alias("_dep_min"),
                hhmm_of(F.col("_d")).alias("_hhmm"))
    arr_min, dep_min, hhmm = F.col("_arr_min"), F.col("_dep_min"), F.col("_hhmm")
    split("stop_times", st,  # a time without seconds only serves timetables, an unreadable departure only sequences
          (hhmm.isNotNull() | arr_min.isNotNull()) & (_text("stop_id") != ""),
          _text("trip_id").alias("trip_id"), _text("stop_id").alias("stop_id"),
          _text("stop_sequence").try_cast("int").alias("seq"), arr_min.alias("arr_min"),
          F.col("_dep").alias("dep_text"), F.coalesce(dep_min, arr_min).alias("dep_min"),
          hhmm.alias("hhmm"), F.nullif(_text("stop_headsign"), F.lit("")).alias("headsign"))
    bad["stop_times"] = bad["stop_times"].drop("_at", "_dt", "_arr", "_dep", "_a", "_d", "_arr_min", "_dep_min", "_hhmm")
    split("transfers", raw["transfers"], (_text("from_stop_id") != "") & (_text("to_stop_id") != ""),
          _text("from_stop_id").alias("from_id"), _text("to_stop_id").alias("to_id"),
          F.coalesce(_text("min_transfer_time").try_cast("double"), F.lit(0.0)).alias("seconds"))
    plat, plon, pseq = (F.col("shape_pt_lat").try_cast("double"),
                        F.col("shape_pt_lon").try_cast("double"),
                        F.col("shape_pt_sequence").try_cast("bigint"))
    split("shapes", raw["shapes"],
          (_text("shape_id") != "") & plat.isNotNull() & plon.isNotNull() & pseq.isNotNull(),
          _text("shape_id").alias("shape_id"), pseq.alias("seq"), plat.alias("lat"),
          plon.alias("lon"))
    flags = FEED_COLUMNS["calendar"][1:8]
    split("calendar", raw["calendar"], _text("service_id") != "",
          _text("service_id").alias("service_id"),
          *[(_text(d) == "1").alias(d) for d in flags],
          _day("start_date").alias("start_date"), _day("end_date").alias("end_date"))
    split("calendar_dates", raw["calendar_dates"],
          (_text("service_id") != "") & _day("date").isNotNull(),
          _text("service_id").alias("service_id"), _day("date").alias("date"),
          _text("exception_type").alias("exception_type"))
    return good, bad


def read_gtfs(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The eight typed tables of a feed folder."""
    return coerce(read_raw(spark, folder))[0]
