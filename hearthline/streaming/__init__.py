"""Continuous forms of the operators; each gives the answers of its batch twin."""

from .jobs import AVAILABLE_NOW, drain, run_enrich, run_ingest, run_purge, run_view_tracking, stream_trackable_views
from .logs import (
    append_log,
    claim_answers,
    history,
    lateness,
    online,
    read_log,
    stream_claims,
    stream_history,
    stream_late_arrivals,
    stream_staleness,
    stream_views,
    view_history,
)
from .state import closed_means, corrections, devices_seen_by_day, judge_arrivals, stale_alarms, stream_devices_seen, stream_judged

__all__ = [
    "AVAILABLE_NOW",
    "append_log",
    "claim_answers",
    "closed_means",
    "corrections",
    "devices_seen_by_day",
    "drain",
    "history",
    "judge_arrivals",
    "lateness",
    "online",
    "read_log",
    "run_enrich",
    "run_ingest",
    "run_purge",
    "run_view_tracking",
    "stale_alarms",
    "stream_claims",
    "stream_devices_seen",
    "stream_history",
    "stream_judged",
    "stream_late_arrivals",
    "stream_staleness",
    "stream_trackable_views",
    "stream_views",
    "view_history",
]
