"""The schedule tables every timetable and network job starts from."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from ..operators import schedule as G
from ..session import save_table
from ..sources import adapters
from ..sources.gtfs import coerce, read_gtfs


@dataclass
class Feed:
    """Typed feed tables and the derived tables shared between jobs."""

    tables: dict[str, DataFrame]

    @classmethod
    def from_folder(cls, spark: SparkSession, folder: str) -> Feed:
        return cls(read_gtfs(spark, folder))

    @classmethod
    def from_tables(cls, spark: SparkSession, sf_dir: str) -> Feed:
        return cls(coerce(adapters.gtfs(spark, sf_dir))[0])

    @cached_property
    def stops(self) -> DataFrame:
        return G.classify_stops(self.tables["stops"])

    @cached_property
    def routes(self) -> DataFrame:
        return G.classify_routes(self.tables["routes"])

    @cached_property
    def calls(self) -> DataFrame:
        return G.trip_calls(self.tables["stop_times"], self.tables["trips"], self.routes, self.stops)

    @cached_property
    def sequences(self) -> DataFrame:
        return G.trip_stops(self.calls)

    @cached_property
    def saved_sequences(self) -> DataFrame:
        """The sequences as a written table, for jobs that read all of them more than once."""
        return save_table(self.sequences, "sequences")

    @cached_property
    def heads(self) -> DataFrame:
        """One row per trip, written as the periods and the choice of representatives read it."""
        return save_table(G.trip_heads(self.calls), "heads")

    @cached_property
    def days(self) -> DataFrame:
        return G.service_days(self.tables["calendar"], self.tables["calendar_dates"])

    @cached_property
    def buckets(self) -> DataFrame:
        return G.service_buckets(self.tables["calendar"], self.tables["calendar_dates"])

    @cached_property
    def periods(self) -> DataFrame:
        return G.trip_periods(self.heads, self.days)

    @cached_property
    def reps(self) -> DataFrame:
        return G.representative_trips(self.heads, self.periods)

    @cached_property
    def rep_stops(self) -> DataFrame:
        """Only the stop times of chosen trips are read, joined and put in order again."""
        chosen = save_table(self.reps, "chosen")
        few = lambda name: self.tables[name].join(chosen.select("trip_id").distinct(), "trip_id", "left_semi")
        calls = G.trip_calls(few("stop_times"), few("trips"), self.routes, self.stops)
        return save_table(G.representative_stops(calls, chosen), "representatives")

    @cached_property
    def timetable_calls(self) -> DataFrame:
        return G.timetable_calls(self.tables["stop_times"], self.tables["trips"], self.buckets)
