"""Pairs of segments meet once, whatever is asked of their crossings."""

from pyspark.sql import functions as F

from headway.operators import spatial as P


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def ways(spark, lines):
    return spark.createDataFrame(
        [(i, n, g) for i, (n, g) in enumerate(lines)], "way_id int, name string, geometry array<struct<lat:double,lon:double>>")


def test_crossings_meet_pairs_once(spark):
    """A filter on the crossings must not be written into the join of the segments, nor the join be run per kind of meeting."""
    w = ways(spark, [("Elm St", [(41.9, -87.61), (41.9, -87.59)]), ("Oak St", [(41.89, -87.6), (41.91, -87.6)])])
    found = P.crossing_streets(w.withColumn("name", F.upper("name")))
    text = plan(found.where(P.in_city(F.col("lat"), F.col("lon"))))
    assert text.count("Join Inner") == 1
    join = next(line for line in text.split("\n") if "Join Inner" in line)
    assert "/" not in join
    assert [(r.name_a, r.name_b, r.lat_q, r.lon_q) for r in found.collect()] == [("elm", "oak", 4190000, -8760000)]


def test_crossings_of_touching_and_odd_segments(spark):
    w = ways(spark, [
        ("A St", [(41.9, -87.61), (41.9, -87.60)]), ("B St", [(41.9, -87.60), (41.9, -87.59)]),      # on one line, one shared end
        ("C St", [(41.9, -87.605), (41.9, -87.595)]),                                               # runs along both
        ("D St", [(41.8, -87.7), (41.8, -87.7)]), ("E St", [(41.8, -87.71), (41.8, -87.69)]),        # a point on a segment
        ("F St", [(41.7, -87.7), (41.7, -87.69)]), ("G St", [(41.7, -87.69), (41.71, -87.69)]),      # a corner
        ("H St", [(41.7, None), (41.7, -87.69)])])
    got = {(r.name_a, r.name_b, r.lat_q, r.lon_q) for r in P.crossing_streets(w).collect()}
    assert got == {("a", "b", 4190000, -8760000), ("f", "g", 4170000, -8769000)}
