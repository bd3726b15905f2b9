"""Geocode result cache: replay of a snapshot and its journal, eviction."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.text import expand_suffixes

# Bounds and default of an entry's age in seconds, time to live.
DAY = 86_400
MIN_AGE, DEFAULT_AGE, MAX_AGE = 1 * DAY, 30 * DAY, 60 * DAY
TTL_DAYS = 90


def _entries(df: DataFrame, phase: int) -> DataFrame:
    """(key, value JSON, seq) with the value's shape made explicit."""
    v = F.trim("value")
    pair = F.from_json(v, "array<double>")
    ok = v.rlike(r"^\[") & (F.size(pair) == 2) & pair[0].isNotNull() & pair[1].isNotNull()
    return df.select(
        "key", F.lit(phase).alias("phase"), F.col("seq").cast("bigint").alias("seq"),
        F.when(v == "null", "negative").when(ok, "positive").otherwise("malformed").alias("state"),
        F.when(ok, pair[0]).alias("lat"), F.when(ok, pair[1]).alias("lon"))


def replay(snapshot: DataFrame, journal: DataFrame) -> DataFrame:
    """Last write per key; the journal follows the snapshot. `n_writes` combine first."""
    both = _entries(snapshot, 0).unionByName(_entries(journal, 1)).where(F.col("key").isNotNull())
    return both.groupBy("key").agg(
        F.max(F.struct("phase", "seq", "state", "lat", "lon")).alias("w"), F.count("*").alias("n_writes")
    ).select("key", "w.*", "n_writes")


def replay_cache(snapshot: DataFrame, journal: DataFrame, ages: DataFrame, now: int) -> DataFrame:
    """Canonical cache rows; malformed ones dropped, the last of colliding keys kept.

    The order among colliding keys is that of their first appearance in the
    replayed map: snapshot order, then journal order.
    """
    first = (
        _entries(snapshot, 0).unionByName(_entries(journal, 1)).groupBy("key")
        .agg(F.min(F.struct("phase", "seq")).alias("first_seen"))
    )
    rows = replay(snapshot, journal).where(F.col("state") != "malformed").join(first, "key")
    canonical = expand_suffixes(F.lower(F.trim("key")))
    recorded = F.when(F.col("recorded_at") > 0, F.floor("recorded_at"))
    at = F.coalesce(recorded, F.lit(now - DEFAULT_AGE))
    at = F.least(F.greatest(at, F.lit(now - MAX_AGE)), F.lit(now - MIN_AGE))
    keyed = rows.join(ages, "key", "left").select(
        canonical.alias("query"), "first_seen", "lat", "lon", at.cast("bigint").alias("fetched_at")
    ).where(F.col("query") != "")
    return keyed.groupBy("query").agg(
        F.max(F.struct("first_seen", "lat", "lon", "fetched_at")).alias("w"),
        (F.count("*") - 1).alias("collisions"),
    ).select("query", "w.lat", "w.lon", "w.fetched_at", "collisions")


def replay_summary(snapshot: DataFrame, journal: DataFrame) -> DataFrame:
    """Keys by outcome, in one pass."""
    r = replay(snapshot, journal)
    blank = F.trim("key") == ""
    return r.agg(
        F.count("*").alias("keys"),
        F.count_if((F.col("state") == "positive") & ~blank).alias("positive"),
        F.count_if((F.col("state") == "negative") & ~blank).alias("negative"),
        F.count_if((F.col("state") == "malformed") | blank).alias("malformed"),
    )


def evict_older_than(cache: DataFrame, days: int, now: int) -> tuple[DataFrame, Observation | None]:
    """Rows still fresh, and an observation of how many were dropped once written.

    `days` <= 0 keeps everything.
    """
    if days <= 0:
        return cache, None
    stale = F.col("fetched_at") < now - days * DAY
    seen = Observation("eviction")
    return cache.observe(seen, F.count_if(stale).alias("deleted")).where(~stale), seen
