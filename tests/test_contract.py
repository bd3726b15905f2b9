import os

import duckdb
import pytest

import __spark_entry__ as entry
from check import TABLES, normal

DIR = "/root/testdata/sf0.001"
SAMPLE = ["session_metrics_30min", "funnel_6h", "rate_demand", "trip_stops", "hop_edges", "radius_join", "dedupe_addresses",
          "parse_bus_predictions", "weather_asof", "legs_from_path", "rank_itineraries"]
NAMES = SAMPLE if os.environ.get("HEADWAY_QUICK") else sorted(entry.oracle_sql())


def test_entry(spark):
    assert entry.entry(spark).columns == ["date", "sessions", "avg_duration_seconds", "bounce_rate_pct"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    got, want = entry.queries()[name](spark, DIR).toPandas(), con.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert normal(got) == normal(want)
