"""Visit log in batch and as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.web import client_ip
from ..operators.analytics import VISIT_PATHS

VISIT_SCHEMA = (
    "ts timestamp_ntz, path string, real_ip string, forwarded_for string, peer string, "
    "user_agent string, referer string, sid string, rid string, event_name string"
)


def _shape(df: DataFrame) -> DataFrame:
    ip = client_ip(F.col("real_ip"), F.col("forwarded_for"), F.col("peer")).alias("ip")
    return df.select("ts", "path", ip, "user_agent", "referer", "sid", "rid", "event_name")


def read_visits(spark: SparkSession, path: str) -> DataFrame:
    """Analytics-eligible requests; the path filter reaches the scan."""
    raw = spark.read.schema(VISIT_SCHEMA).parquet(path)
    return _shape(raw.where(F.col("path").isin(VISIT_PATHS)))


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Named events, kept apart from visits."""
    raw = spark.read.schema(VISIT_SCHEMA).parquet(path)
    return _shape(raw.where(F.col("event_name").isNotNull()))


def stream_visits(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """The same rows as they arrive."""
    r = spark.readStream.schema(VISIT_SCHEMA)
    if files_per_batch:
        r = r.option("maxFilesPerTrigger", files_per_batch)
    return _shape(r.parquet(path).where(F.col("path").isin(VISIT_PATHS)))
