"""Raw messages to validated readings, dead letters and metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from ..functions import (
    device_id_ok,
    has_nul,
    is_blank,
    iso_instant,
    parse_double,
    parse_instant,
    strip_nul,
    truncate_millis,
)

# The wire format is strict JSON.
_JSON = {"mode": "PERMISSIVE", "allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}
_WRITE_JSON = {"ignoreNullFields": "false"}

# How the wire spells booleans and nulls inside quotes.
_TRUE, _FALSE = ["true", "True", "TRUE"], ["false", "False", "FALSE"]
_NULL_TEXT = ["", "null"]
PURGE_ACTION = "PURGE"
LIVE_PREFIX = "/topic/device."


def _decode(text: Column, schema: T.StructType) -> Column:
    """The fields of a JSON document as a generator of one row.

    A generator is evaluated once per row.  A plain ``from_json`` column would be
    copied into every filter on one of its fields and parsed again for each.
    """
    return F.inline(F.array(F.from_json(text, schema, _JSON)))


def _number(leaf: Column) -> tuple[Column, Column]:
    """(value, malformed) of an optional number that may be quoted."""
    text = F.trim(leaf)
    value = F.when(~text.isin(_NULL_TEXT), parse_double(text))
    return value, leaf.isNotNull() & ~text.isin(_NULL_TEXT) & value.isNull()


def _flag(raw: Column, leaf: Column) -> tuple[Column, Column]:
    """(value, malformed) of an optional boolean; a bare integer counts, a quoted one does not."""
    text = F.trim(leaf)
    bare = F.from_json(raw, "data struct<heatingStatus:bigint>", _JSON)["data"]["heatingStatus"]
    value = (
        F.when(text.isin(_TRUE), F.lit(True))
        .when(text.isin(_FALSE), F.lit(False))
        .when(text.rlike(r"^-?\d+\z"), bare != 0)
    )
    return value, leaf.isNotNull() & ~text.isin(_NULL_TEXT) & value.isNull()


def _nested(raw: Column, field: str, leaf: Column) -> Column:
    """True when ``field`` holds an object or array where text is declared.

    The second look at the document only happens for text that starts like one.
    """
    as_map = F.from_json(raw, f"{field} map<string,string>", _JSON)[field]
    as_list = F.from_json(raw, f"{field} array<string>", _JSON)[field]
    return F.when(leaf.rlike(r"^[\{\[]"), as_map.isNotNull() | as_list.isNotNull()).otherwise(False)


def parse_telemetry(raw: DataFrame, value: str = "value") -> DataFrame:
    """Decode JSON readings and mark each row ``valid`` or not.

    Every input row is kept with its original text, and ``valid`` is never null,
    so the two branches below always add up to the input.
    """
    text = F.col(value)
    fields = _decode(text, schemas.TELEMETRY_JSON).alias("_id", "_time", "_data")
    decoded = raw.select("*", fields)
    device, data = F.col("_id"), F.col("_data")
    current, _ = _number(data["currentTemperature"])
    target, target_bad = _number(data["targetTemperature"])
    heating, heating_bad = _flag(text, data["heatingStatus"])
    ts = parse_instant(F.col("_time"))
    valid = (
        ~is_blank(device)
        & ~has_nul(device)
        & ~_nested(text, "deviceId", device)
        & ts.isNotNull()
        & current.isNotNull()
        & ~target_bad
        & ~heating_bad
    )
    row = F.struct(
        device.alias("device_id"),
        ts.alias("ts"),
        current.alias("current_temperature"),
        target.alias("target_temperature"),
        heating.alias("heating"),
        F.coalesce(valid, F.lit(False)).alias("valid"),
    )
    # A generator again: a filter on ``valid`` reads a column instead of parsing once more.
    return decoded.select(*raw.columns, F.inline(F.array(row)))


def valid_telemetry(parsed: DataFrame) -> DataFrame:
    return parsed.filter("valid").drop("valid")


def invalid_telemetry(parsed: DataFrame) -> DataFrame:
    return parsed.filter("NOT valid").drop("valid")


def dead_letters(parsed: DataFrame, value: str = "value") -> DataFrame:
    """The original text of every invalid row, unkeyed."""
    return parsed.filter("NOT valid").select(F.col(value).alias("value"))


def validity_counts(parsed: DataFrame) -> DataFrame:
    return parsed.agg(
        F.count_if("valid").alias("telemetry_valid"),
        F.count_if(~F.col("valid")).alias("telemetry_invalid"),
    )


def to_points(events: DataFrame) -> DataFrame:
    """Readings as time-series points: millisecond time, heating as 0 or 1."""
    carried = [c for c in ("partition", "arrival", "arrival_ts") if c in events.columns]
    return events.select(
        "device_id",
        truncate_millis(F.col("ts")).alias("ts"),
        "current_temperature",
        "target_temperature",
        F.when(F.col("heating"), 1).otherwise(0).alias("heating_status"),
        *carried,
    )


def encode_telemetry(events: DataFrame) -> DataFrame:
    """Readings back to JSON text, null fields written."""
    body = F.struct(
        F.col("device_id").alias("deviceId"),
        iso_instant(F.col("ts")).alias("timestamp"),
        F.struct(
            F.col("current_temperature").alias("currentTemperature"),
            F.col("target_temperature").alias("targetTemperature"),
            F.col("heating").alias("heatingStatus"),
        ).alias("data"),
    )
    return events.withColumn("value", F.to_json(body, _WRITE_JSON))


def keyed_records(events: DataFrame) -> DataFrame:
    """Sink records keyed by device, so one device stays in one topic partition.

    A row without a key is left out.  ``ts`` rides along as a column because the
    Kafka sink cannot set the record time.
    """
    keyed = events.filter(F.col("device_id").isNotNull())
    return encode_telemetry(keyed).select(F.col("device_id").alias("key"), "value", "ts")


def parse_purges(raw: DataFrame, value: str = "value") -> DataFrame:
    """Devices named by well-formed PURGE events; everything else is dropped."""
    kept = [c for c in raw.columns if c != value]
    text, device, action = F.col(value), F.col("_id"), F.col("_action")
    fields = _decode(text, schemas.PURGE_JSON).alias("_id", "_action")
    return (
        raw.select("*", fields)
        .filter((action == PURGE_ACTION) & ~_nested(text, "deviceId", device))
        .select(device.alias("device_id"), *kept)
    )


def device_id_guard(df: DataFrame, column: str = "device_id") -> DataFrame:
    """Strip NUL characters and mark ids that are not 36 hex digits or dashes."""
    clean = strip_nul(F.col(column))
    return df.withColumn(column, clean).withColumn("device_id_ok", device_id_ok(F.col(column)))


def route_messages(messages: DataFrame) -> DataFrame:
    """Broker messages to keyed records; ``route`` is ``telemetry`` or ``invalid``.

    A topic is valid when it has exactly three levels, ``iot/telemetry/<id>``; the
    id may be empty.
    """
    parts = F.split("topic", "/", -1)
    valid = (
        (F.size(parts) == 3)
        & (F.get(parts, F.lit(0)) == "iot")
        & (F.get(parts, F.lit(1)) == "telemetry")
    )
    valid = F.coalesce(valid, F.lit(False))
    kept = [c for c in messages.columns if c not in ("topic", "payload")]
    return messages.select(
        F.when(valid, F.get(parts, F.lit(2))).alias("key"),
        F.col("payload").alias("value"),
        F.when(valid, "telemetry").otherwise("invalid").alias("route"),
        *kept,
    )


def live_routes(records: DataFrame) -> DataFrame:
    """Processed records to per-device live destinations; rows without a key are dropped."""
    return records.filter("key IS NOT NULL AND key <> ''").select(
        F.concat(F.lit(LIVE_PREFIX), "key").alias("destination"),
        F.col("value").alias("payload"),
    )


def ingest_metrics(messages: DataFrame, window: str | None = None, ts: str = "ts") -> DataFrame:
    """Received, invalid-topic, sent and failed counts with the success rate.

    ``messages`` are broker messages; an optional boolean ``delivered`` column
    tells whether the hand-over of a valid message succeeded.
    """
    routed = route_messages(messages)
    delivered = F.col("delivered") if "delivered" in messages.columns else F.lit(True)
    is_valid = F.col("route") == "telemetry"
    keys = [F.window(ts, window).start.alias("window_start")] if window else []
    counts = routed.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("received"),
        F.count_if(~is_valid).alias("invalid_topics"),
        F.count_if(is_valid & F.coalesce(delivered, F.lit(False))).alias("sent"),
        F.count_if(is_valid & ~F.coalesce(delivered, F.lit(False))).alias("failed"),
    )
    rate = F.col("sent") / F.greatest("received", F.lit(1)) * 100
    return counts.withColumn("success_rate", F.round(rate, 2))


def devices_seen(messages: DataFrame) -> DataFrame:
    """Distinct devices with valid, non-empty ids and how often each was seen."""
    routed = route_messages(messages).filter("route = 'telemetry' AND key <> ''")
    return routed.groupBy(F.col("key").alias("device_id")).agg(F.count(F.lit(1)).alias("messages"))


def devices_seen_count(messages: DataFrame, approximate: bool = False) -> DataFrame:
    """How many distinct devices were seen; the approximate form keeps a small sketch."""
    routed = route_messages(messages).filter("route = 'telemetry' AND key <> ''")
    count = F.approx_count_distinct("key") if approximate else F.count_distinct("key")
    return routed.agg(count.alias("devices"))
