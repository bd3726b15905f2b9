"""Distances, bearings, boxes and grid cells over lat/lon doubles."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Earth radii, degrees-to-miles factors, city boxes and centre.
EARTH_MILES = 3958.8
EARTH_METRES = 6_371_000.0
METRES_PER_MILE = 1609.344
MILES_PER_DEG_LAT = 69.0
WALK_MPH = 3.0
CITY_BOX = (41.64, 42.02, -87.94, -87.52)
STREET_BOX = (41.7120, 42.0190, -87.7750, -87.5200)
CORRIDOR_BOX = (42.0190, 42.0830, -87.7100, -87.6600)
CITY_CENTRE = (41.8827, -87.6326)


def haversine_inner(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Monotone inner term of the haversine; enough for comparisons."""
    p1, p2 = F.radians(lat1), F.radians(lat2)
    s1 = F.sin((p2 - p1) / 2)
    s2 = F.sin((F.radians(lon2) - F.radians(lon1)) / 2)
    return s1 * s1 + F.cos(p1) * F.cos(p2) * s2 * s2


def haversine(lat1, lon1, lat2, lon2, radius: float = EARTH_MILES) -> Column:
    a = haversine_inner(lat1, lon1, lat2, lon2)
    return F.lit(2 * radius) * F.asin(F.sqrt(F.when(a > 1, 1.0).otherwise(a)))  # null stays null


def haversine_metres(lat1, lon1, lat2, lon2) -> Column:
    return haversine(lat1, lon1, lat2, lon2, EARTH_METRES)


def walk_minutes(miles: Column) -> Column:
    """Straight-line walking time at 3 mph."""
    return miles / F.lit(WALK_MPH) * F.lit(60.0)


def bearing(lat1, lon1, lat2, lon2) -> Column:
    """Initial compass bearing in [0, 360)."""
    p1, p2 = F.radians(lat1), F.radians(lat2)
    dl = F.radians(lon2 - lon1)
    y = F.sin(dl) * F.cos(p2)
    x = F.cos(p1) * F.sin(p2) - F.sin(p1) * F.cos(p2) * F.cos(dl)
    return F.pmod(F.degrees(F.atan2(y, x)) + 360, F.lit(360.0))


def cardinal(b: Column) -> Column:
    return (
        F.when((b < 45) | (b >= 315), "Northbound")
        .when(b < 135, "Eastbound")
        .when(b < 225, "Southbound")
        .when(b < 315, "Westbound")
        .otherwise("Northbound")
    )


def heading8(lat1, lon1, lat2, lon2) -> Column:
    """Nearest of the eight headings N, NE, .. NW on a locally flat map."""
    dlon = (lon2 - lon1) * F.cos(F.radians((lat1 + lat2) / 2))
    b = F.pmod(F.degrees(F.atan2(dlon, lat2 - lat1)), F.lit(360.0))
    names = F.array(*[F.lit(n) for n in ("N", "NE", "E", "SE", "S", "SW", "W", "NW")])
    return F.element_at(names, (F.round(b / 45).cast("int") % 8) + 1)


def in_box(lat: Column, lon: Column, box: tuple) -> Column:
    s, n, w, e = box
    return lat.between(s, n) & lon.between(w, e)


def quantise(v: Column) -> Column:
    """Coordinate at 1e-5 degree as a whole number."""
    return F.round(v * 100_000).cast("bigint")


def snap2(v: Column) -> Column:
    return F.round(v, 2)


def cell(v: Column, size: float) -> Column:
    return F.floor(v / F.lit(size)).cast("bigint")


def point_segment_metres(plat, plon, alat, alon, blat, blon) -> Column:
    """Distance from a point to a segment, flat at the segment's mid latitude."""
    k = math.pi / 180 * EARTH_METRES
    kx = F.cos(F.radians((alat + blat) / 2)) * k
    px, py = (plon - alon) * kx, (plat - alat) * k
    dx, dy = (blon - alon) * kx, (blat - alat) * k
    len2 = dx * dx + dy * dy
    t = F.coalesce((px * dx + py * dy) / F.nullif(len2, F.lit(0.0)), F.lit(0.0))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    ex, ey = px - t * dx, py - t * dy
    return F.sqrt(ex * ex + ey * ey)


def path_metres(plat: Column, plon: Column, path: Column) -> Column:
    """Least distance from a point to a polyline of (lat, lon) structs."""
    one = haversine_metres(plat, plon, path[0]["lat"], path[0]["lon"])
    segs = F.transform(
        F.sequence(F.lit(1), F.size(path) - 1),
        lambda i: point_segment_metres(
            plat, plon, path[i - 1]["lat"], path[i - 1]["lon"], path[i]["lat"], path[i]["lon"]
        ),
    )
    return F.when(F.size(path) == 1, one).when(F.size(path) > 1, F.array_min(segs))
