"""Device registry: lookups, enrichment, command checks and table mutations.

A mutation is a pure function from the table and a set of requests to the new
table; writers decide which partitions to replace.  Requests may be as skewed
as any other log, so they are reduced to one row per device (and user) with
map-side aggregation before they meet the table.  Joins put the large or skewed
side on the left and carry no hint: Spark broadcasts the other side only when
its estimated size allows, and AQE splits skewed left partitions otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import clock, interval, is_blank, parse_double, utf16_length
from .ingest import PURGE_ACTION

# Command bounds and defaults of a new device.
MIN_TEMPERATURE, MAX_TEMPERATURE = -40.0, 100.0
MAX_NAME = 50
FALLBACK_TARGET, TOLERANCE = 22.0, 0.1
NEW_DEVICE_TARGET, NEW_DEVICE_NAME, NAME_ID_CHARS = 20.0, "New Device ", 4
SET_TARGET, RESET, RESET_CODE_CHARS = "set_target_temp", "reset_device", 8
RETENTION_DAYS = 30


def active_devices(
    devices: DataFrame, requests: DataFrame | None = None, keys: list[str] | None = None
) -> DataFrame:
    """Active devices; with ``requests``, those named by them on ``keys``
    (``device_id``, ``user_id`` or both)."""
    active = devices.filter("is_active")
    return active if requests is None else find_devices(active, requests, keys or ["device_id"])


def find_devices(devices: DataFrame, requests: DataFrame, keys: list[str]) -> DataFrame:
    """Devices in any state named by ``requests`` on ``keys``."""
    return devices.join(requests.select(*keys).distinct(), keys, "left_semi")


def public_devices(devices: DataFrame) -> DataFrame:
    return devices.select(
        "device_id", "name", "location", "is_active", "deactivated_at", "target_temperature"
    )


# --- command checks -------------------------------------------------------


def validate_temperature(commands: DataFrame) -> DataFrame:
    """Parse ``value`` (text) and say whether it may be set, and why not."""
    number = parse_double(F.col("value"))
    reason = (
        F.when(F.col("value").isNull(), "MISSING")
        .when(number.isNull() | F.isnan(number), "NOT_A_NUMBER")
        .when(~number.between(MIN_TEMPERATURE, MAX_TEMPERATURE), "OUT_OF_RANGE")
    )
    return commands.select(
        *commands.columns,
        F.when(reason.isNull(), number).alias("temperature"),
        reason.isNull().alias("ok"),
        reason.alias("reason"),
    )


def validate_rename(commands: DataFrame) -> DataFrame:
    reason = F.when(is_blank(F.col("name")), "BLANK").when(
        utf16_length(F.col("name")) > MAX_NAME, "TOO_LONG"
    )
    return commands.select(
        *commands.columns, reason.isNull().alias("ok"), reason.alias("reason")
    )


def deleted_users(identity: DataFrame) -> DataFrame:
    """Users that identity events report as deleted."""
    gone = F.col("type").contains("DELETE") & ~is_blank(F.col("user_id"))
    return identity.filter(gone).select("user_id").distinct()


# --- enrichment -----------------------------------------------------------


def enrich(points: DataFrame, devices: DataFrame) -> DataFrame:
    """Points with name, location and stored target of their device, if known."""
    known = devices.select(
        "device_id", "name", "location", F.col("target_temperature").alias("stored_target")
    )
    return points.join(known, "device_id", "left")


def enrich_as_of(points: DataFrame, versions: DataFrame, slice_: str = "1 day") -> DataFrame:
    """Points with the name and stored target that their device had at the time of the reading, if any.

    ``versions`` has (device_id, valid_from, seq, name, target_temperature): what a device was called from then on;
    of versions from the same moment that with the highest seq counts.  Points and versions of a device are put in order
    within time slices; a slice begins with one row, the version that the slices before it leave.  So neither a busy
    device nor one that is renamed often is worked on as a whole.
    """
    named = F.struct("seq", F.col("name").alias("known_name"), F.col("target_temperature").alias("stored_target"))
    own = versions.filter(F.col("valid_from").isNotNull()).select(
        "device_id", F.col("valid_from").alias("_at"), F.lit(0).alias("_row"), F.col("seq").alias("_seq"), named.alias("_version")
    )
    asked = points.withColumns({"_at": F.col("ts"), "_row": F.lit(1)})
    untimed = asked.filter(F.col("_at").isNull()).drop("_at", "_row")
    slice_start = F.window("_at", slice_).start
    cut = own.withColumn("_slice", slice_start)
    timed = asked.filter(F.col("_at").isNotNull()).withColumn("_slice", slice_start)
    last = cut.groupBy("device_id", "_slice").agg(F.max_by("_version", F.struct("_at", "_seq")).alias("_version"))
    slices = last.unionByName(timed.select("device_id", "_slice").distinct(), allowMissingColumns=True)
    each = slices.groupBy("device_id", "_slice").agg(F.first("_version", ignorenulls=True).alias("_version"))
    before = W.partitionBy("device_id").orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    lead = each.select(
        "device_id", "_slice", F.lit(-1).alias("_row"), F.last("_version", ignorenulls=True).over(before).alias("_version")
    ).filter(F.col("_version").isNotNull())
    order = W.partitionBy("device_id", "_slice").orderBy(F.col("_row") >= 0, "_at", "_row", "_seq")
    so_far = order.rowsBetween(W.unboundedPreceding, W.currentRow)
    every = timed.unionByName(cut, allowMissingColumns=True).unionByName(lead, allowMissingColumns=True)
    found = every.withColumn("_known", F.last("_version", ignorenulls=True).over(so_far)).filter("_row = 1")
    result = found.select(
        *points.columns, F.col("_known.known_name").alias("name"), F.col("_known.stored_target").alias("stored_target")
    )
    return result.unionByName(untimed, allowMissingColumns=True)


def hvac_status(enriched: DataFrame) -> DataFrame:
    """HEATING, COOLING or IDLE from the reading and its effective target."""
    stored = F.when(
        F.col("stored_target").between(MIN_TEMPERATURE, MAX_TEMPERATURE), F.col("stored_target")
    )
    target = F.coalesce("target_temperature", stored, F.lit(FALLBACK_TARGET))
    running = F.col("heating_status") == 1
    current = F.col("current_temperature")
    return enriched.withColumn("effective_target", target).withColumn(
        "status",
        F.when(running & (current < F.col("effective_target") - TOLERANCE), "HEATING")
        .when(running & (current > F.col("effective_target") + TOLERANCE), "COOLING")
        .otherwise("IDLE"),
    )


# --- ownership ------------------------------------------------------------


def _owners(devices: DataFrame) -> DataFrame:
    return devices.filter("is_active").select("device_id", "user_id")


def owned_requests(requests: DataFrame, devices: DataFrame) -> DataFrame:
    """Requests on an active device that the requester owns."""
    return requests.join(_owners(devices), ["device_id", "user_id"], "left_semi")


def denied_requests(requests: DataFrame, devices: DataFrame) -> DataFrame:
    return requests.join(_owners(devices), ["device_id", "user_id"], "left_anti")


# --- mutations ------------------------------------------------------------


def _deactivate(devices: DataFrame, chosen: Column, as_of: str) -> DataFrame:
    now = clock(devices, "deactivated_at", as_of)
    return devices.withColumns(
        {
            "deactivated_at": F.when(chosen, now).otherwise(F.col("deactivated_at")),
            "is_active": F.col("is_active") & ~chosen,
        }
    )


def soft_delete(devices: DataFrame, requests: DataFrame, as_of: str) -> DataFrame:
    """New table in which active devices are inactive once their owner asked for it."""
    asked = requests.select("device_id", "user_id").distinct().withColumn("_asked", F.lit(True))
    joined = devices.join(asked, ["device_id", "user_id"], "left")
    chosen = F.coalesce("_asked", F.lit(False)) & F.col("is_active")
    return _deactivate(joined, chosen, as_of).select(*devices.columns)


def soft_delete_outcomes(devices: DataFrame, requests: DataFrame) -> DataFrame:
    """One row per distinct request: DELETED or NOT_FOUND."""
    found = _owners(devices).withColumn("_found", F.lit(True))
    return (
        requests.select("device_id", "user_id")
        .distinct()
        .join(found, ["device_id", "user_id"], "left")
        .select(
            "device_id",
            "user_id",
            F.when(F.col("_found"), "DELETED").otherwise("NOT_FOUND").alias("outcome"),
        )
    )


def deactivate_users(devices: DataFrame, users: DataFrame, as_of: str) -> DataFrame:
    """New table in which every active device of the given users is inactive."""
    gone = users.select("user_id").distinct().withColumn("_gone", F.lit(True))
    joined = devices.join(gone, "user_id", "left")
    chosen = F.coalesce("_gone", F.lit(False)) & F.col("is_active")
    return _deactivate(joined, chosen, as_of).select(*devices.columns)


def apply_commands(devices: DataFrame, commands: DataFrame) -> DataFrame:
    """New table after valid temperature and rename commands of the owners.

    ``commands`` has (device_id, user_id, value, name, seq); a row may carry
    either or both.  The last valid command per field wins.
    """
    checked = validate_temperature(commands).withColumnRenamed("ok", "_value_ok").drop("reason")
    checked = validate_rename(checked).withColumnRenamed("ok", "_name_ok")
    wanted = checked.groupBy("device_id", "user_id").agg(
        F.max_by("temperature", F.when(F.col("_value_ok"), F.col("seq"))).alias("_target"),
        F.max_by("name", F.when(F.col("_name_ok"), F.col("seq"))).alias("_name"),
    )
    joined = devices.join(wanted, ["device_id", "user_id"], "left")
    return joined.withColumns(
        {
            "target_temperature": F.when(
                F.col("is_active"), F.coalesce("_target", "target_temperature")
            ).otherwise(F.col("target_temperature")),
            "name": F.when(F.col("is_active"), F.coalesce("_name", "name")).otherwise(F.col("name")),
        }
    ).select(*devices.columns)


def expired_devices(
    devices: DataFrame, as_of: str, days: int = RETENTION_DAYS
) -> DataFrame:
    """Inactive devices that were deactivated more than ``days`` ago."""
    return devices.filter(_expired(devices, as_of, days))


def retain_devices(devices: DataFrame, as_of: str, days: int = RETENTION_DAYS) -> DataFrame:
    return devices.filter(~_expired(devices, as_of, days))


def _expired(devices: DataFrame, as_of: str, days: int) -> Column:
    cutoff = clock(devices, "deactivated_at", as_of) - interval(f"{days} days")
    return F.coalesce(~F.col("is_active") & (F.col("deactivated_at") < cutoff), F.lit(False))


def provision(devices: DataFrame, claimed: DataFrame) -> DataFrame:
    """The table plus one new device per successful claim.

    ``claimed`` has (id, device_id, hashed_device_token, user_id); ids and
    tokens come in as columns so that a rerun gives the same rows.
    """
    return devices.unionByName(new_devices(devices, claimed))


def new_devices(devices: DataFrame, claimed: DataFrame) -> DataFrame:
    defaults = {
        "name": F.concat(F.lit(NEW_DEVICE_NAME), F.substring("device_id", 1, NAME_ID_CHARS)),
        "location": F.lit(None),
        "is_active": F.lit(True),
        "deactivated_at": F.lit(None),
        "target_temperature": F.lit(NEW_DEVICE_TARGET),
    }
    return claimed.select(
        *[
            defaults.get(f.name, F.col(f.name)).cast(f.dataType).alias(f.name)
            for f in devices.schema.fields
        ]
    )


# --- outgoing events ------------------------------------------------------


def purge_events(expired: DataFrame) -> DataFrame:
    """One PURGE record per expired device, keyed by device."""
    body = F.struct(F.col("device_id").alias("deviceId"), F.lit(PURGE_ACTION).alias("action"))
    return expired.select(F.col("device_id").alias("key"), F.to_json(body).alias("value"))


def command_events(requests: DataFrame) -> DataFrame:
    """Device commands from (device_id, command, number, text).

    Text values are quoted, numbers are bare.  Setting a target is retained by
    the broker, a reset is not.
    """
    value = F.when(F.col("text").isNotNull(), F.format_string('"%s"', "text")).otherwise(
        F.col("number").cast("string")
    )
    return requests.select(
        F.concat(F.lit("devices/"), "device_id", F.lit("/commands")).alias("topic"),
        F.concat(
            F.lit('{"command": "'), "command", F.lit('", "value": '), value, F.lit("}")
        ).alias("payload"),
        F.lit(1).alias("qos"),
        (F.col("command") == SET_TARGET).alias("retained"),
    )


def temperature_requests(commands: DataFrame, devices: DataFrame) -> DataFrame:
    """Accepted temperature commands in the shape ``command_events`` takes."""
    accepted = owned_requests(validate_temperature(commands).filter("ok"), devices)
    return accepted.select(
        "device_id",
        F.lit(SET_TARGET).alias("command"),
        F.col("temperature").alias("number"),
        F.lit(None).cast("string").alias("text"),
    )


def reset_requests(requests: DataFrame, devices: DataFrame) -> DataFrame:
    """One reset per device that its owner deletes, with its confirmation code."""
    deleted = owned_requests(requests.select("device_id", "user_id").distinct(), devices)
    return deleted.select(
        "device_id",
        F.lit(RESET).alias("command"),
        F.lit(None).cast("double").alias("number"),
        F.substring("device_id", 1, RESET_CODE_CHARS).alias("text"),
    )
