"""Time-of-day, service-day and service-period expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LOCAL_TZ = "America/Chicago"

# Service periods (name, weekday set with 0 = Monday, half-open
# minute windows, target minute of the representative trip).
PERIODS = [
    ("weekday_peak", [0, 1, 2, 3, 4], [(360, 570), (930, 1140)], 480),
    ("weekday_midday", [0, 1, 2, 3, 4], [(570, 930)], 720),
    ("weekday_evening", [0, 1, 2, 3, 4], [(1140, 1320)], 1230),
    ("weekend", [5, 6], [(300, 1320)], 720),
    ("owl", [0, 1, 2, 3, 4, 5, 6], [(1320, 1440), (0, 300)], 120),
]


def local_ts(ts: Column, tz: str = LOCAL_TZ) -> Column:
    """Civil time in `tz` of a UTC wall-clock (NTZ) value."""
    return F.convert_timezone(F.lit("UTC"), F.lit(tz), ts.cast("timestamp_ntz"))


def local_date(ts: Column, tz: str = LOCAL_TZ) -> Column:
    return local_ts(ts, tz).cast("date")


def epoch_us(ts: Column) -> Column:
    """Microseconds since 1970 of an NTZ value, whatever the session zone is."""
    days = F.datediff(ts.cast("date"), F.lit("1970-01-01").cast("date")).cast("bigint")
    secs = F.hour(ts) * 3600 + F.minute(ts) * 60
    frac = F.extract(F.lit("SECOND"), ts) * 1_000_000
    return days * 86_400_000_000 + secs.cast("bigint") * 1_000_000 + frac.cast("bigint")


def weekday(d: Column) -> Column:
    """0 = Monday .. 6 = Sunday."""
    return F.weekday(d)


def clock_parts(text: Column) -> Column:
    """`HH:MM[:SS]` in pieces; name it as a column before using it more than once."""
    return F.split(F.trim(text), ":")


def _part(parts: Column, i: int) -> Column:
    return F.get(parts, F.lit(i)).try_cast("int")


def minutes_of(parts: Column) -> Column:
    h, m, s = (_part(parts, i) for i in (0, 1, 2))
    return (h * F.lit(60.0) + m + s / F.lit(60.0)).cast("double")


def hhmm_of(parts: Column) -> Column:
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    return F.concat(two(F.pmod(_part(parts, 0), F.lit(24))), F.lit(":"), two(_part(parts, 1)))


def gtfs_minutes(text: Column) -> Column:
    """`HH:MM:SS` (hours may pass 24) to minutes since service-day midnight."""
    return minutes_of(clock_parts(text))


def clock_hhmm(text: Column) -> Column:
    """`HH:MM[:SS]` to `HH:MM` within one day; null when malformed."""
    return hhmm_of(clock_parts(text))


def minutes_text(minutes: Column) -> Column:
    """Whole minutes to `HH:MM:00`, hours past 24 kept."""
    m = minutes.cast("bigint")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    return F.concat(two(F.floor(m / 60)), F.lit(":"), two(m % 60), F.lit(":00"))


def service_period(local: Column) -> Column:
    """Name of the service period a local timestamp falls in."""
    dow, m = weekday(local), F.hour(local) * 60 + F.minute(local)
    return (
        F.when((m >= 1320) | (m < 300), "owl")
        .when(dow >= 5, "weekend")
        .when(m.between(360, 569) | m.between(930, 1139), "weekday_peak")
        .when(m.between(1140, 1319), "weekday_evening")
        .otherwise("weekday_midday")
    )


#: Every window starts and ends on a multiple of this many minutes.
SLOT_MINUTES = 30


def periods(spark: SparkSession) -> DataFrame:
    """One row per (period, day, half-hour slot): a fixed table of some 370 rows."""
    rows = ", ".join(
        f"('{n}', array({', '.join(map(str, d))}), {w[0]}, {w[1]}, {t})"
        for n, d, ws, t in PERIODS for w in ws
    )
    base = spark.sql(
        f"SELECT * FROM VALUES {rows} AS t(period, days, start_min, end_min, target_min)"
    )
    return base.select("period", "target_min", F.explode("days").alias("dow"), F.expr(
        f"cast(sequence(start_min div {SLOT_MINUTES}, end_min div {SLOT_MINUTES} - 1) as array<int>)"
    ).alias("s")).select("period", "target_min", "dow", F.explode("s").alias("slot"))


def sunday_service_holiday(d: Column) -> Column:
    """Three fixed and three floating holidays run Sunday service."""
    mon, day, dow = F.month(d), F.dayofmonth(d), weekday(d)
    fixed = F.date_format(d, "MM-dd").isin("01-01", "07-04", "12-25")
    memorial = (mon == 5) & (dow == 0) & (F.month(F.date_add(d, 7)) != 5)
    labor = (mon == 9) & (dow == 0) & (day <= 7)
    thanks = (mon == 11) & (dow == 3) & day.between(22, 28)
    return fixed | memorial | labor | thanks
