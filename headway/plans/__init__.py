"""End-to-end jobs and the registered queries."""

from . import (  # noqa: F401
    analytics_queries,
    live_queries,
    network_queries,
    place_queries,
    schedule_queries,
    spatial_queries,
    stream_queries,
    trip_queries,
)
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
