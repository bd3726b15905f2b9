"""Spatial joins as equi-joins on grid cells.

Cells are as wide as the radius, so matches lie in the same or a neighbouring
cell. The longitude width of a cell follows its latitude row, which keeps the
join exact at any latitude. A crowded cell is one join key; adaptive skew
handling splits it, and nearest-type joins first fold equal coordinates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.text import street_name
from ..session import settle

# Search rings, caps and intermodal walk limits.
RAIL_RINGS = [0.25, 0.5, 0.75, 1.0, 1.25, 1.5, 1.75, 2.0]
BUS_RINGS = [0.25, 0.5, 0.75, 1.0]
RAIL_K, BUS_K = 3, 5
BUS_DEFAULT_RADIUS = 0.25
ENTRANCE_MILES = 0.20
ADDRESS_METRES = 50.0
LANDMARK_METRES = 200.0
TRANSFER_RADIUS_MILES = 0.15
TRANSFER_MINUTES = 3.0
TRANSFER_WALK_CAP = 5.0
DETOUR_FACTOR = 1.29
SAME_PLACE_DEGREES = 0.001
#: Most rows of one coordinate in one row of a radius join.
BUNDLE = 256
#: Ends of a segment; boxes of segments further apart than the slack, in degrees, cannot meet.
ENDS, BOX_SLACK = ("y1", "x1", "y2", "x2"), 1e-9


# --- predicates ----------------------------------------------------------------


def in_coverage(lat: Column, lon: Column) -> Column:
    """Inside the street network's main box or its northern corridor."""
    return geo.in_box(lat, lon, geo.STREET_BOX) | geo.in_box(lat, lon, geo.CORRIDOR_BOX)


def in_city(lat: Column, lon: Column) -> Column:
    return geo.in_box(lat, lon, geo.CITY_BOX)


def same_place(od: DataFrame) -> DataFrame:
    """Origin-destination pairs too close to be a trip."""
    dlat, dlon = F.col("o_lat") - F.col("d_lat"), F.col("o_lon") - F.col("d_lon")
    return od.where(dlat * dlat + dlon * dlon < SAME_PLACE_DEGREES**2)


# --- radius and nearest -----------------------------------------------------------


def _row_size(miles: float) -> float:
    return miles / geo.MILES_PER_DEG_LAT


def _lon_size(row: Column, miles: float) -> Column:
    """Longitude span of `miles` at the highest latitude a match of this row can have."""
    top = F.least((F.greatest(F.abs(row), F.abs(row + 1)) + 1) * F.lit(_row_size(miles)), F.lit(89.0))
    return F.lit(miles * 1.001 / geo.MILES_PER_DEG_LAT) / F.cos(F.radians(top))


def cell_pairs(a: DataFrame, b: DataFrame, miles: float) -> DataFrame:
    """All pairs of rows at most `miles` apart, with their distance; both sides hold few rows per coordinate.

    Columns as in `radius_join`. `b` is spread over nine cells, which a size
    estimate does not see, so it is never broadcast.
    """
    row = geo.cell(F.col("lat"), _row_size(miles))
    left = a.withColumn("_row", row).withColumn(
        "_col", F.floor(F.col("lon") / _lon_size(F.col("_row"), miles)).cast("bigint")
    )
    right = (
        b.withColumnsRenamed({"lat": "b_lat", "lon": "b_lon"})
        .withColumn("_r0", geo.cell(F.col("b_lat"), _row_size(miles)))
        .withColumn("_row", F.explode(F.sequence(F.col("_r0") - 1, F.col("_r0") + 1)))
        .withColumn("_c0", F.floor(F.col("b_lon") / _lon_size(F.col("_row"), miles)).cast("bigint"))
        .withColumn("_col", F.explode(F.sequence(F.col("_c0") - 1, F.col("_c0") + 1)))
        .drop("_r0", "_c0")
    )
    d = geo.haversine(F.col("lat"), F.col("lon"), F.col("b_lat"), F.col("b_lon"))
    return (
        left.join(right.hint("merge"), ["_row", "_col"]).withColumn("miles", d)
        .where(F.col("miles") <= miles).drop("_row", "_col")
    )


def _bundles(df: DataFrame, name: str) -> DataFrame:
    """Rows of one coordinate in arrays of at most `BUNDLE`; the other columns become structs in `name`."""
    rest = F.struct(*(c for c in df.columns if c not in ("lat", "lon")))
    place = Window.partitionBy("lat", "lon").orderBy(F.lit(0))
    placed = df.where(F.col("lat").isNotNull() & F.col("lon").isNotNull()).select(
        "lat", "lon", rest.alias("_r"), F.floor((F.row_number().over(place) - 1) / BUNDLE).alias("_n"))
    return placed.groupBy("lat", "lon", "_n").agg(F.collect_list("_r").alias(name)).drop("_n")


def radius_join(a: DataFrame, b: DataFrame, miles: float, digits: int | None = None) -> DataFrame:
    """All pairs at most `miles` apart, with their distance, rounded to `digits` if given.

    `a` and `b` have `lat, lon` and otherwise distinct columns; `b`, the side
    spread over neighbouring cells, should be the smaller. Its coordinates come
    out as `b_lat, b_lon`. Rows of one coordinate meet as bundles, so a distance
    is found and rounded once per pair of bundles and the pairs of rows are only written out.
    """
    near = cell_pairs(_bundles(a, "_a"), _bundles(b, "_b"), miles)
    if digits is not None:
        near = near.withColumn("miles", F.round("miles", digits))
    one = near.select("*", F.explode("_a").alias("_x")).drop("_a")
    both = one.select("*", F.explode("_b").alias("_y")).drop("_b")
    own = lambda df: [c for c in df.columns if c not in ("lat", "lon")]
    return both.select(
        *(f"_x.{c}" if c in own(a) else c for c in a.columns),
        *(f"_y.{c}" if c in own(b) else f"b_{c}" for c in b.columns), "miles")


def nearest_within(points: DataFrame, targets: DataFrame, miles: float, target_id: str,
                   strict: bool = False) -> DataFrame:
    """Every point with its nearest target and distance; points without one are dropped.

    Equal coordinates are folded on both sides, so copies of one place cost one
    row each. Ties go to the least id.
    """
    spots = points.select("lat", "lon").distinct()
    places = targets.groupBy("lat", "lon").agg(F.min(target_id).alias(target_id))
    pairs = cell_pairs(spots, places, miles)
    if strict:
        pairs = pairs.where(F.col("miles") < miles)
    best = pairs.groupBy("lat", "lon").agg(F.min(F.struct("miles", target_id)).alias("n")).select(
        "lat", "lon", "n.*")
    return points.join(best, ["lat", "lon"])


def ring_of(miles: Column, rings: list[float]) -> Column:
    """The smallest ring that contains a distance."""
    out = F.when(miles <= rings[0], rings[0])
    for r in rings[1:]:
        out = out.when(miles <= r, r)
    return out


def ring_nearest(points: DataFrame, stops: DataFrame, rings: list[float], k: int,
                 stop_id: str = "stop_id") -> DataFrame:
    """The k nearest stops inside the first non-empty ring, in walking order.

    The first ring settles every point that has a stop in it. For the others the
    k nearest overall, cut at the ring of the nearest, are the same rows, so one
    join at the outer radius replaces a join per ring.
    """
    spots = points.select("lat", "lon").distinct()
    # of stops at one coordinate only the k least can be among the k nearest
    at = Window.partitionBy("lat", "lon").orderBy(stop_id)
    few = stops.where("lat is not null and lon is not null").withColumn("_n", F.row_number().over(at)).where(F.col("_n") <= k).drop("_n")
    pairs = cell_pairs(spots, few, rings[0])
    if len(rings) > 1:
        settled = pairs.select("lat", "lon").distinct()
        pairs = pairs.unionByName(
            cell_pairs(spots.join(settled.hint("merge"), ["lat", "lon"], "left_anti"), few, rings[-1]))
    near = Window.partitionBy("lat", "lon").orderBy("miles", stop_id)
    top = pairs.withColumn("rank", F.row_number().over(near)).where(F.col("rank") <= k)
    first = F.min("miles").over(Window.partitionBy("lat", "lon"))
    picked = top.withColumn("ring", ring_of(first, rings)).where(F.col("miles") <= F.col("ring"))
    picked = picked.withColumn("walk_minutes", F.round(geo.walk_minutes(F.col("miles")), 1))
    return points.join(picked, ["lat", "lon"])


def bus_rings(max_miles: float = BUS_DEFAULT_RADIUS) -> list[float]:
    """Bus rings up to the caller's maximum."""
    rings = [r for r in BUS_RINGS if r <= max_miles]
    return rings if rings and rings[-1] == max_miles else rings + [max_miles]


def intermodal_edges(stations: DataFrame, bus_stops: DataFrame) -> DataFrame:
    """Walk edges between stations and nearby bus stops, both directions."""
    a = bus_stops.select(F.col("stop_id").alias("to_id"), "lat", "lon")
    b = stations.select(F.col("stop_id").alias("from_id"), "lat", "lon")
    m = F.greatest(geo.walk_minutes(F.col("miles")) * DETOUR_FACTOR, F.lit(TRANSFER_MINUTES))
    one = (
        radius_join(a, b, TRANSFER_RADIUS_MILES).withColumn("minutes", m)
        .where(F.col("minutes") <= TRANSFER_WALK_CAP).select("from_id", "to_id", "minutes")
    )
    back = one.select(F.col("to_id").alias("from_id"), F.col("from_id").alias("to_id"), "minutes")
    return one.unionByName(back)


# --- exits ------------------------------------------------------------------------


def exits_per_station(entrances: DataFrame, stations: DataFrame) -> DataFrame:
    """Labelled entrances with their station, numbered by lower-cased label."""
    st = stations.select(F.col("stop_id").alias("station_id"), "lat", "lon")
    near = nearest_within(entrances, st, ENTRANCE_MILES, "station_id")
    label = F.coalesce(
        F.nullif(F.trim("label"), F.lit("")), F.format_string("Entrance (%.4f, %.4f)", "lat", "lon")
    )
    return near.withColumn("label", label).withColumn(
        "exit_no", F.row_number().over(
            Window.partitionBy("station_id").orderBy(F.lower("label"), "entrance_id"))
    ).select("station_id", "exit_no", "entrance_id", "label",
             F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), "miles")


def busiest_stations(exits: DataFrame, k: int = 15) -> DataFrame:
    return exits.groupBy("station_id").agg(F.count("*").alias("exits")).orderBy(
        F.desc("exits"), "station_id").limit(k)


def best_exit(legs: DataFrame, exits: DataFrame) -> DataFrame:
    """Exit of the alighting station nearest on foot to the destination, or null."""
    e = exits.select("station_id", "label", F.col("lat").alias("x_lat"), F.col("lon").alias("x_lon"))
    d = geo.haversine(F.col("x_lat"), F.col("x_lon"), F.col("d_lat"), F.col("d_lon"))
    inner = geo.haversine_inner(F.col("x_lat"), F.col("x_lon"), F.col("d_lat"), F.col("d_lon"))
    best = (
        legs.select("station_id", "d_lat", "d_lon").distinct().join(e, "station_id")
        .groupBy("station_id", "d_lat", "d_lon")
        .agg(F.min(F.struct(inner.alias("i"), "label", "x_lat", "x_lon",
                            F.round(geo.walk_minutes(d), 1).alias("walk_minutes"))).alias("b"))
        .select("station_id", "d_lat", "d_lon", F.col("b.label").alias("exit_label"),
                "b.x_lat", "b.x_lon", "b.walk_minutes")
    )
    return legs.join(best, ["station_id", "d_lat", "d_lon"], "left")


# --- crossing streets ---------------------------------------------------------------


def way_segments(ways: DataFrame) -> DataFrame:
    """Distinct named segments of ways with (way_id, name, geometry)."""
    g = F.col("geometry")
    pieces = F.transform(
        F.sequence(F.lit(1), F.size(g) - 1),
        lambda i: F.struct(g[i - 1]["lat"].alias("y1"), g[i - 1]["lon"].alias("x1"),
                           g[i]["lat"].alias("y2"), g[i]["lon"].alias("x2")),
    )
    named = ways.withColumn("canon", street_name(F.col("name"))).where(
        (F.col("canon") != "") & (F.size("geometry") >= 2))
    return named.select("canon", F.col("name").alias("raw"), F.inline(pieces)).groupBy(
        "canon", "y1", "x1", "y2", "x2").agg(F.min("raw").alias("raw"))


def crossing_streets(ways: DataFrame, cell: float = 0.005) -> DataFrame:
    """Points where two differently named ways cross, names in order.

    A pair is tested only in the first cell both segments touch. Segments that
    run along each other are no crossing.
    """
    s = way_segments(ways)
    lo = lambda p, q: geo.cell(F.least(p, q), cell)
    hi = lambda p, q: geo.cell(F.greatest(p, q), cell)
    s = s.select("*", lo("x1", "x2").alias("cx0"), lo("y1", "y2").alias("cy0"),
                 hi("x1", "x2").alias("cx1"), hi("y1", "y2").alias("cy1"))
    cells = s.withColumn("cx", F.explode(F.sequence("cx0", "cx1"))).withColumn(
        "cy", F.explode(F.sequence("cy0", "cy1"))).drop("cx1", "cy1")
    # few bytes, many pairs: a number of partitions that is asked for is not merged into fewer
    cells = cells.repartition(int(s.sparkSession.conf.get("spark.sql.shuffle.partitions")), "cx", "cy")
    a = cells.select(*[F.col(c).alias(c if c in ("cx", "cy") else f"a_{c}") for c in cells.columns])
    b = cells.select(*[F.col(c).alias(c if c in ("cx", "cy") else f"b_{c}") for c in cells.columns])
    c = F.col
    apart = lambda lo, hi, x: F.least(c(f"{lo}_{x}1"), c(f"{lo}_{x}2")) > F.greatest(
        c(f"{hi}_{x}1"), c(f"{hi}_{x}2")) + BOX_SLACK
    pairs = a.join(b, ["cx", "cy"]).where(
        (c("a_canon") < c("b_canon"))
        & (c("cx") == F.greatest("a_cx0", "b_cx0")) & (c("cy") == F.greatest("a_cy0", "b_cy0"))
        & ~(apart("a", "b", "x") | apart("b", "a", "x") | apart("a", "b", "y") | apart("b", "a", "y"))
    ).select("a_canon", "b_canon", "a_raw", "b_raw", *(f"a_{n}" for n in ENDS), *(f"b_{n}" for n in ENDS))
    rx, ry, sx, sy, qx, qy = (c(n) for n in ("rx", "ry", "sx", "sy", "qx", "qy"))
    step = settle(
        pairs, (c("a_x2") - c("a_x1")).alias("rx"), (c("a_y2") - c("a_y1")).alias("ry"),
        (c("b_x2") - c("b_x1")).alias("sx"), (c("b_y2") - c("b_y1")).alias("sy"),
        (c("b_x1") - c("a_x1")).alias("qx"), (c("b_y1") - c("a_y1")).alias("qy"))
    step = settle(
        step, (rx * sy - ry * sx).alias("den"), (qx * sy - qy * sx).alias("t_up"), (qx * ry - qy * rx).alias("u_up"),
        (rx * rx + ry * ry).alias("r2"), (qx * rx + qy * ry).alias("q_r"), (sx * rx + sy * ry).alias("s_r"))
    # segments on one line touch in a point when they only share an end
    crosses, on_line = c("den") != 0, (c("den") == 0) & (c("u_up") == 0) & (c("r2") != 0)
    t0 = c("q_r") / c("r2")
    t1 = t0 + c("s_r") / c("r2")
    step = settle(
        step.where(crosses | on_line),
        F.when(crosses, c("t_up") / c("den")).otherwise(F.greatest(F.lit(0.0), F.least(t0, t1))).alias("t"),
        F.when(crosses, c("u_up") / c("den")).alias("u"),
        F.when(on_line, F.least(F.lit(1.0), F.greatest(t0, t1))).alias("t_hi"))
    met = (crosses & c("t").between(0, 1) & c("u").between(0, 1)) | (on_line & (c("t") == c("t_hi")))
    spots = settle(
        step.where(met).select(
            "a_canon", "b_canon", "a_raw", "b_raw", (c("a_x1") + c("t") * rx).alias("x"), (c("a_y1") + c("t") * ry).alias("y")),
        geo.quantise(c("y")).alias("lat_q"), geo.quantise(c("x")).alias("lon_q"))
    return (
        spots.groupBy(c("a_canon").alias("name_a"), c("b_canon").alias("name_b"), "lat_q", "lon_q")
        .agg(F.min("a_raw").alias("raw_a"), F.min("b_raw").alias("raw_b"))
        .select("name_a", "name_b", "raw_a", "raw_b", "lat_q", "lon_q",
                (c("lat_q") / 1e5).alias("lat"), (c("lon_q") / 1e5).alias("lon"))
    )
