"""Crowding score of a boarding."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .timecode import weekday

# Base score per period, hub multipliers, live-load scores.
BASE = {"peak": 0.75, "regular": 0.45, "off_peak": 0.20}
HUBS = {
    "40380": 1.35, "40730": 1.30, "40850": 1.25, "40900": 1.20, "40890": 1.15,
    "40930": 1.15, "41220": 1.20, "41320": 1.25, "41450": 1.20, "40450": 1.15,
}
LIVE = {"EMPTY": (0.10, "low"), "HALF_EMPTY": (0.45, "moderate"), "FULL": (0.90, "high")}
LEVELS = ["low", "moderate", "high", "very_high"]


def _pick(key: Column, table: dict, default) -> Column:
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), F.lit(default))


def day_type(local: Column, is_holiday: Column) -> Column:
    return (
        F.when(is_holiday, "holiday").when(weekday(local) >= 5, "weekend").otherwise("weekday")
    )


def time_period(local: Column, day: Column) -> Column:
    """peak / regular / off_peak; a holiday counts as a weekend."""
    m = F.hour(local) * 60 + F.minute(local)
    week = (
        F.when(m.between(390, 569) | m.between(930, 1109), "peak")
        .when(m.between(570, 929) | m.between(1110, 1259), "regular")
        .otherwise("off_peak")
    )
    end = F.when(m.between(540, 1259), "regular").otherwise("off_peak")
    return F.when(day == "weekday", week).otherwise(end)


def bound(direction_text: Column) -> Column:
    """South and east lead into the centre."""
    d = F.lower(direction_text)
    return F.when(d.contains("south") | d.contains("east"), "inbound").otherwise("outbound")


def heuristic(period, direction, hour, position, total, stop_id) -> Column:
    """Score in [0, 1] from period, direction, place on the line and hub."""
    morning = hour < 12
    dir_mult = F.when(period != "peak", 1.0).otherwise(
        F.when((direction == "inbound") == morning, 1.2).otherwise(0.8)
    )
    bell = F.when(total <= 0, 1.0).otherwise(
        0.6 + 0.4 * F.sin(position / total * math.pi)
    )
    hub = F.when(stop_id.try_cast("bigint") >= 40000, _pick(stop_id, HUBS, 1.0)).otherwise(1.0)
    raw = _pick(period, BASE, 0.45) * dir_mult * bell * hub
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw))


def level(score: Column) -> Column:
    return (
        F.when(score >= 0.80, "very_high")
        .when(score >= 0.55, "high")
        .when(score >= 0.30, "moderate")
        .otherwise("low")
    )


def estimate(period, direction, hour, position, total, stop_id, live_load=None) -> Column:
    """Struct (score, level, confidence); a known live load overrides."""
    s = heuristic(period, direction, hour, position, total, stop_id)
    conf = F.when(period == "peak", "medium").otherwise("low")
    est = F.struct(F.round(s, 3).alias("score"), level(s).alias("level"), conf.alias("confidence"))
    if live_load is None:
        return est
    live = F.struct(
        _pick(live_load, {k: v[0] for k, v in LIVE.items()}, 0.0).alias("score"),
        _pick(live_load, {k: v[1] for k, v in LIVE.items()}, "low").alias("level"),
        F.lit("high").alias("confidence"),
    )
    return F.when(live_load.isin(list(LIVE)), live).otherwise(est)


def ordinal(level_name: Column) -> Column:
    return F.array_position(F.array(*[F.lit(x) for x in LEVELS]), level_name) - 1
