"""Whole flows composed of the operators."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.devices import (
    RETENTION_DAYS,
    expired_devices,
    owned_requests,
    purge_events,
    retain_devices,
)
from ..operators.ingest import parse_telemetry, to_points, valid_telemetry
from ..operators.series import (
    DEFAULT_RANGE,
    HISTORY_RANGES,
    bucket_means,
    merge_points,
    telemetry_histories,
)
from ..operators.views import retain_views


def raw_to_history(raw: DataFrame, width: str) -> DataFrame:
    """Raw JSON readings to the history of every device: decode, validate, upsert, average."""
    events = valid_telemetry(parse_telemetry(raw))
    return bucket_means(merge_points(to_points(events)), width)


def requested_history(
    points: DataFrame, devices: DataFrame, requests: DataFrame, as_of: str
) -> DataFrame:
    """History for requests (device_id, user_id, range) of owners of active devices, in one scan of the points."""
    known = F.when(F.col("range").isin(list(HISTORY_RANGES)), F.col("range"))
    asked = (
        owned_requests(requests, devices)
        .select("device_id", F.coalesce(known, F.lit(DEFAULT_RANGE)).alias("range"))
        .distinct()
    )
    return telemetry_histories(points, asked, as_of)


class Retention(NamedTuple):
    views: DataFrame
    devices: DataFrame
    purges: DataFrame


def retention(
    views: DataFrame, devices: DataFrame, as_of: str, days: int = RETENTION_DAYS
) -> Retention:
    """The daily clean-up: old views go, expired devices go and are announced as purges."""
    return Retention(
        retain_views(views, as_of, days),
        retain_devices(devices, as_of, days),
        purge_events(expired_devices(devices, as_of, days)),
    )
