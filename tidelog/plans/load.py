"""Importing this module registers every query."""

from tidelog.plans import (  # noqa: F401
    queries_bi,
    queries_dead_letters,
    queries_events,
    queries_metrics,
    queries_quality,
    queries_schema,
    queries_sources,
    queries_state,
)
