"""Public panels: only white-listed columns leave the daily tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .analytics import FUNNEL_STAGES, pct

# The columns each panel may show.
PANEL_COLUMNS = {
    "dau": ["date", "count"],
    "geography": ["date", "metro", "total", "share_pct"],
    "sessions": ["date", "sessions", "avg_duration_seconds", "bounce_rate_pct"],
    "hourly": ["date", "hours", "total"],
    "devices": ["date", "mobile", "tablet", "desktop", "total"],
    "referrers": ["date", "direct", "search", "social", "other", "total"],
    "events": ["date", "recommend_submitted", "recommend_returned", "route_selected",
               "trip_completed", "total"],
    "funnel": ["date", "stages", "counts", "result_rate_pct"],
    "retention": ["date", "new", "returning", "total", "returning_pct"],
}
PUBLIC_EVENTS = ["recommend_submitted", "recommend_returned", "route_selected", "trip_completed"]


def _n(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0)).cast("bigint")


def _sum(names: list[str]) -> Column:
    total = _n(names[0])
    for n in names[1:]:
        total = total + _n(n)
    return total


def _array_total(name: str) -> Column:
    return F.aggregate(F.col(name), F.lit(0).cast("bigint"), lambda a, x: a + x)


def public_panel(daily: DataFrame, panel: str) -> DataFrame:
    """Project one daily table to its public form; totals use published parts only."""
    d = daily.withColumnRenamed("day", "date")
    if panel == "hourly":
        d = d.where(F.size("hours") == 24).withColumn("total", _array_total("hours"))
    elif panel == "funnel":
        d = d.where(F.size("counts") == len(FUNNEL_STAGES)).withColumn(
            "counts", F.transform("counts", lambda x: F.greatest(x, F.lit(0)))
        ).withColumn("stages", F.array(*[F.lit(s) for s in FUNNEL_STAGES])).withColumn(
            "result_rate_pct", pct(F.col("counts")[2], F.col("counts")[0])
        )
    elif panel == "devices":
        d = d.withColumn("total", _sum(["mobile", "tablet", "desktop"]))
    elif panel == "referrers":
        d = d.withColumn("total", _sum(["direct", "search", "social", "other"]))
    elif panel == "events":
        d = d.withColumn("total", _sum(PUBLIC_EVENTS))
    elif panel == "retention":
        d = d.withColumn("total", _sum(["new", "returning"])).withColumn(
            "returning_pct", pct(_n("returning"), F.col("total"))
        )
    return d.select(*PANEL_COLUMNS[panel]).orderBy("date")


def latest_day(panel: DataFrame) -> DataFrame:
    """The `today` row of a panel."""
    return panel.orderBy(F.desc("date")).limit(1)


def recent_days(panel: DataFrame, n: int = 30) -> DataFrame:
    """The last n days of a panel (the trend)."""
    return panel.orderBy(F.desc("date")).limit(n)
