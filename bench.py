"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from headway.plans import QUERIES
from headway.session import build_session

HEADLINE = [
    "daily_active", "hourly_histogram", "session_metrics_30min", "funnel_30min", "new_vs_returning",
    "rate_demand", "event_counts", "ip_to_city", "trip_stops", "representative_trips", "timetable",
    "last_departures", "network_edges", "rides", "radius_join", "nearest_within", "ring_nearest",
    "crossing_streets", "fuzzy_match", "autocomplete", "reverse_geocode", "replay_cache",
    "parse_train_arrivals", "pick_wait", "weather_asof", "walk_steps", "detour_factor",
    "legs_from_path", "rank_itineraries", "geocode", "itineraries", "bus_bus",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus,
                          spark__ui__enabled="false", spark__driver__memory="16g",
                          spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    spark.read.parquet(f"{sf_dir}/region.parquet").groupBy("r_name").count().collect()
    times = {}
    for name in names:
        t = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t, 3)
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
