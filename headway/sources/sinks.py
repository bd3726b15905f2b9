"""Sinks: timetable documents, daily tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def file_safe(route_id: Column) -> Column:
    """Route id usable as a file name."""
    return F.regexp_replace(route_id, r"[^A-Za-z0-9_\-]", "_")


def write_timetables(documents: DataFrame, folder: str) -> None:
    """One folder of JSON per route and a manifest of the routes written.

    Routes without trips have no document and so no entry.
    """
    docs = documents.withColumn("file", file_safe(F.col("route_id")))
    docs.write.mode("overwrite").partitionBy("file").json(f"{folder}/routes")
    manifest = docs.select("route_id", "file", "short_name", "long_name", "category")
    manifest.write.mode("overwrite").json(f"{folder}/manifest")


def upsert_daily(df: DataFrame, path: str, day: str = "date") -> None:
    """Replace the days present in `df`; all other days stay as they are."""
    (
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy(day).parquet(path)
    )
