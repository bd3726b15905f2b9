"""Distances of a radius join are rounded per pair of bundles, before its rows are written out."""

from pyspark.sql import functions as F

from headway.operators import spatial as P


def test_rounding_happens_below_the_rows(spark):
    a = spark.range(40).select(F.col("id").alias("target_id"), (F.lit(41.8) + F.col("id") % 4 * 0.002).alias("lat"), F.lit(-87.7).alias("lon"))
    b = spark.range(30).select(F.col("id").alias("point_id"), (F.lit(41.8) + F.col("id") % 3 * 0.0031).alias("lat"), F.lit(-87.701).alias("lon"))
    cols = ["point_id", "target_id"]
    want = sorted(P.radius_join(a, b, 0.4).select(*cols, F.round("miles", 6).alias("miles")).collect())
    got = P.radius_join(a, b, 0.4, digits=6).select(*cols, "miles")
    assert sorted(got.collect()) == want and 0 < len(want) < 1200
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("round(") == 1 and plan.index("Generate") < plan.index("round(")
