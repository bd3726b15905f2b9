"""Street graph tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_street_graph(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a graph folder; an edge without length counts as 0 m."""
    nodes = spark.read.parquet(f"{folder}/nodes").select(
        "node", F.col("y").alias("lat"), F.col("x").alias("lon"))
    edges = spark.read.parquet(f"{folder}/edges")
    return nodes, edges.withColumn("length", F.coalesce(F.col("length").cast("double"), F.lit(0.0)))
