"""Sliding-window rate limits: a request counts only when it was accepted."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.timecode import epoch_us

US = 1_000_000


@dataclass(frozen=True)
class Limit:
    """Accepted requests allowed per minute, hour and, optionally, day."""

    per_minute: int
    per_hour: int
    per_day: int | None = None

    @property
    def reach_us(self) -> int:
        return (86_400 if self.per_day else 3_600) * US


# The buckets.
BUCKETS = {"recommend": Limit(10, 50, 50), "geocode": Limit(60, 600), "events": Limit(120, 1200)}


class SlidingWindow:
    """Accepted times of one address; the rule itself, shared by batch and stream.

    The hourly bucket also counts what the daily quota then refuses, the way
    the checks follow one another.
    """

    def __init__(self, limit: Limit, recent: list[int] = (), daily: list[int] = ()):
        self.limit, self.recent, self.daily = limit, deque(recent), deque(daily)

    def room(self, now: int) -> int:
        """How many requests at `now` the minute and hour checks let through."""
        while self.recent and now - self.recent[0] > 3600 * US:
            self.recent.popleft()
        minute = sum(1 for t in reversed(self.recent) if now - t <= 60 * US)
        return max(0, min(self.limit.per_hour - len(self.recent), self.limit.per_minute - minute))

    def take(self, now: int, n: int) -> int:
        """Accept up to n requests made at `now`; the first ones win."""
        n = min(n, self.room(now))
        self.recent.extend([now] * n)
        if self.limit.per_day is None:
            return n
        while self.daily and now - self.daily[0] > 86_400 * US:
            self.daily.popleft()
        n = min(n, self.limit.per_day - len(self.daily))
        self.daily.extend([now] * n)
        return n


def _chains(requests: DataFrame, limit: Limit) -> DataFrame:
    """Requests per (address, microsecond), cut into chains at idle spells.

    After a pause longer than the longest window nothing accepted before can
    count, so a chain is decided alone. Requests of one instant combine first.
    """
    ticks = requests.groupBy("ip", F.col("us").alias("at")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("ip").orderBy("at")
    cut = F.coalesce((F.col("at") - F.lag("at").over(w) > limit.reach_us).cast("int"), F.lit(1))
    return ticks.withColumn("_cut", cut).withColumn("chain", F.sum("_cut").over(w)).drop("_cut")


def rate_limit(requests: DataFrame, limit: Limit) -> DataFrame:
    """Every request with `allowed`, decided in order of time (to the microsecond), then id."""
    r = requests.select("visit_id", "ip", epoch_us(F.col("ts")).alias("us"))
    chains = _chains(r, limit)

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, rule = None, SlidingWindow(limit)
        for pdf in batches:
            taken = []
            for ip, chain, at, n in zip(pdf["ip"], pdf["chain"], pdf["at"], pdf["n"]):
                if (ip, chain) != key:
                    key, rule = (ip, chain), SlidingWindow(limit)
                taken.append(rule.take(int(at), int(n)))
            yield pdf[["ip", "at"]].assign(accepted=taken)

    # chains are independent; a sorted pass carries the accepted times of one
    taken = chains.repartition("ip", "chain").sortWithinPartitions("ip", "chain", "at").mapInPandas(
        decide, "ip string, at long, accepted long")
    order = Window.partitionBy("ip", "at").orderBy("visit_id")
    return (
        r.withColumn("at", F.col("us")).join(taken, ["ip", "at"])
        .withColumn("allowed", F.row_number().over(order) <= F.col("accepted"))
        .select("visit_id", "ip", "us", "allowed")
    )


def limit_summary(decided: DataFrame) -> DataFrame:
    return decided.groupBy("ip").agg(
        F.count("*").alias("requests"), F.count_if("allowed").alias("allowed"))


