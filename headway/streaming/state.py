"""Keyed state of the streams: rate limits, first visits, trip progress."""

from __future__ import annotations

import json
from collections.abc import Iterator
from types import SimpleNamespace

from pyspark.sql import Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from ..operators.limits import Limit, SlidingWindow
from ..operators.tracking import TRIP_HOURS, Trip, advance

DAY_MS = 86_400_000
#: Most rows that one call adds to a list in state.
APPEND_ROWS = 5000


class Expiring(StatefulProcessor):
    """State that is dropped once event time passes the last row by `keep_ms`."""

    keep_ms = DAY_MS

    def open(self, handle: StatefulProcessorHandle, name: str, schema: StructType) -> None:
        self.handle = handle
        self.value = handle.getValueState(name, schema)

    def extend(self, last_us: int) -> None:
        """Keeps the state until `keep_ms` after the last row; an older row does not shorten its life."""
        until = last_us // 1000 + self.keep_ms
        for t in list(self.handle.listTimers()):
            if t >= until:
                return
            self.handle.deleteTimer(t)
        self.handle.registerTimer(until)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.value.clear()
        return iter([])

    def close(self) -> None:
        pass


class RateLimiter(Expiring):
    """Accepted times of one address; idle state expires with the longest window."""

    def __init__(self, limit: Limit):
        self.limit = limit
        self.keep_ms = limit.reach_us // 1000 + 1

    def init(self, handle: StatefulProcessorHandle) -> None:
        schema = StructType([
            StructField("recent", ArrayType(LongType())), StructField("daily", ArrayType(LongType()))])
        self.open(handle, "times", schema)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        old = self.value.get() if self.value.exists() else ([], [])
        rule, now = SlidingWindow(self.limit, old[0], old[1]), 0
        for r in sorted(rows, key=lambda r: (r.us, r.visit_id)):
            now = r.us
            yield Row(visit_id=r.visit_id, ip=key[0], us=now, allowed=rule.take(now, 1) == 1)
        self.value.update((list(rule.recent), list(rule.daily)))
        self.extend(now)


class FirstVisit(Expiring):
    """First day of a visitor, forgotten after `days` without traffic."""

    def __init__(self, days: int = 90):
        self.days = days
        self.keep_ms = days * DAY_MS

    def init(self, handle: StatefulProcessorHandle) -> None:
        schema = StructType([StructField("days", ArrayType(StringType()))])
        self.open(handle, "seen", schema)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        # first day plus the days already reported, at most one per day of the cookie
        known = list(self.value.get()[0]) if self.value.exists() else []
        days = {}
        for r in rows:
            days[r.day] = max(r.us, days.get(r.day, 0))
        for day in sorted(days):
            if day not in known:
                known.append(day)
                yield Row(rid=key[0], day=day, returning=day > min(known))
        first = min(known)
        self.value.update((sorted({first, *sorted(known)[-self.days:]}),))
        self.extend(max(days.values()))


class TripTracker(Expiring):
    """Leg pointer, finished steps and reroute suppression of one trip."""

    keep_ms = TRIP_HOURS * 3_600_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        schema = StructType([
            StructField("leg", IntegerType()), StructField("done", ArrayType(StringType())),
            StructField("quiet_until", LongType())])
        self.open(handle, "trip", schema)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        s = self.value.get() if self.value.exists() else (0, [], 0)
        trip, now = Trip(s[0], set(s[1]), s[2]), 0
        for r in sorted(rows, key=lambda r: r.us):
            now = r.us
            yield Row(trip_id=key[0], us=now, **advance(trip, r))
        self.value.update((trip.leg, sorted(trip.done), trip.quiet_until))
        self.extend(now)


# --- rows in order of their own time ---------------------------------------------------


class InOrder(StatefulProcessor):
    """Rows wait in keyed state until the watermark has passed their time, then count in order of time.

    What comes before the watermark is dropped by Spark, so no earlier row can
    follow: the decisions are those of one sorted pass, however rows and batches
    arrive. Rows are (us, tie, payload); equal ones are kept with their number. State is read
    and written once per key and call, not once per row.
    The value is kept until `keep_ms` after the newest row that counted, and
    that time only moves forward.
    """

    keep_ms = DAY_MS

    def start(self, handle: StatefulProcessorHandle, name: str, *fields: StructField) -> None:
        self.handle = handle
        self.value = handle.getValueState(name, StructType([*fields, StructField("until", LongType())]))
        self.waiting = handle.getListState("waiting", StructType([
            StructField("us", LongType()), StructField("tie", LongType()), StructField("payload", StringType()),
            StructField("n", LongType())]))

    def wake(self, ms: int) -> None:
        """A timer at `ms`, unless an earlier one is set."""
        if not any(t <= ms for t in self.handle.listTimers()):
            self.handle.registerTimer(ms)

    def append(self, rows: list[tuple]) -> None:
        for i in range(0, len(rows), APPEND_ROWS):
            self.waiting.appendList(rows[i:i + APPEND_ROWS])

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        got = {}
        for r in rows:
            place = (r.us, r.tie)
            got[place] = (r.payload, got[place][1] + 1 if place in got else 1)
        if got:
            self.append([(*place, *row) for place, row in got.items()])
            self.wake(-(-min(got)[0] // 1000))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs()
        rows = {}
        for us, tie, payload, n in self.waiting.get():
            rows[us, tie] = (payload, n + (rows[us, tie][1] if (us, tie) in rows else 0))
        ready = sorted(place for place in rows if place[0] <= now * 1000)
        old = self.value.get() if self.value.exists() else None
        state = self.load(None if old is None else tuple(old)[:-1])
        until = 0 if old is None else old[-1]
        for us, tie in ready:
            payload, n = rows.pop((us, tie))
            for _ in range(n):
                yield from self.count(key, state, us, tie, payload)
            until = max(until, us // 1000 + self.keep_ms)
        if ready:
            self.waiting.clear()
            self.append([(*place, *row) for place, row in rows.items()])
        if until > now:
            self.value.update((*self.store(state), until))
            self.wake(until + 1)
        elif old is not None:
            self.value.clear()
        if rows:
            self.wake(-(-min(rows)[0] // 1000))

    def close(self) -> None:
        pass


class OrderedRateLimiter(InOrder):
    """As RateLimiter, with requests decided in order of time over all batches."""

    def __init__(self, limit: Limit):
        self.limit = limit
        self.keep_ms = limit.reach_us // 1000 + 1

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.start(handle, "times", StructField("recent", ArrayType(LongType())), StructField("daily", ArrayType(LongType())))

    def load(self, old) -> SlidingWindow:
        return SlidingWindow(self.limit, *(old or ([], [])))

    def store(self, rule: SlidingWindow) -> tuple:
        return list(rule.recent), list(rule.daily)

    def count(self, key, rule: SlidingWindow, us: int, tie: int, payload: str) -> Iterator[Row]:
        yield Row(visit_id=tie, ip=key[0], us=us, allowed=rule.take(us, 1) == 1)


class OrderedFirstVisit(InOrder):
    """Days of a visitor in order: the first is new, later ones are returning."""

    def __init__(self, days: int = 90):
        self.keep_ms = days * DAY_MS

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.start(handle, "seen", StructField("last", StringType()))

    def load(self, old) -> SimpleNamespace:
        return SimpleNamespace(last=old[0] if old else None)

    def store(self, seen: SimpleNamespace) -> tuple:
        return (seen.last,)

    def count(self, key, seen: SimpleNamespace, us: int, tie: int, payload: str) -> Iterator[Row]:
        if seen.last is None or payload > seen.last:
            yield Row(rid=key[0], day=payload, returning=seen.last is not None)
            seen.last = payload


class OrderedTripTracker(InOrder):
    """As TripTracker, with pings followed in order of time over all batches."""

    keep_ms = TRIP_HOURS * 3_600_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.start(handle, "trip", StructField("leg", LongType()), StructField("done", ArrayType(StringType())),
                   StructField("quiet_until", LongType()), StructField("last_us", LongType()))

    def load(self, old) -> SimpleNamespace:
        leg, done, quiet, last = old or (0, [], 0, None)
        return SimpleNamespace(trip=Trip(leg, set(done), quiet), last=last)

    def store(self, s: SimpleNamespace) -> tuple:
        return s.trip.leg, sorted(s.trip.done), s.trip.quiet_until, s.last

    def count(self, key, s: SimpleNamespace, us: int, tie: int, payload: str) -> Iterator[Row]:
        if s.last is not None and us - s.last > self.keep_ms * 1000:
            s.trip = Trip()
        s.last = us
        ping = json.loads(payload)
        legs = [{"leg_type": None, "to_end": None, "to_path": None, "steps": None} | g for g in ping.get("legs", [])]
        row = SimpleNamespace(us=us, on_vehicle=ping.get("on_vehicle"), rerouted=ping.get("rerouted"), legs=legs)
        yield Row(trip_id=key[0], us=us, **advance(s.trip, row))
