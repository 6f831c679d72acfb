"""Audit of broker access requests against the device registry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import commands_topic_ok

# Access codes and topic roots of the broker.
READ, WRITE, SUBSCRIBE = 1, 2, 4
TELEMETRY_ROOT = "iot/telemetry/"


def evaluate_access(requests: DataFrame, devices: DataFrame, bridge: str | None) -> DataFrame:
    """Decide every request (username, acc, topic) and name the rule that decided.

    A request of the bridge that no bridge rule allows is judged as a device's.
    """
    active = devices.filter("is_active").select(
        F.col("device_id").alias("username"), F.lit(True).alias("_active")
    )
    user, acc, topic = F.col("username"), F.col("acc"), F.col("topic")
    listens, writes = acc.isin(READ, SUBSCRIBE), acc == WRITE
    is_bridge = user.eqNullSafe(F.lit(bridge)) & F.lit(bridge is not None)
    own_telemetry = topic == F.concat(F.lit(TELEMETRY_ROOT), user)
    own_commands = topic == F.concat(F.lit("devices/"), user, F.lit("/commands"))
    rule = (
        F.when(is_bridge & listens & topic.startswith(TELEMETRY_ROOT), "bridge_telemetry")
        .when(is_bridge & writes & commands_topic_ok(topic), "bridge_command")
        .when(F.col("_active").isNull(), "inactive_device")
        .when(writes & own_telemetry, "own_telemetry")
        .when(writes, "foreign_write")
        .when(listens & own_commands, "own_commands")
        .otherwise("not_permitted")
    )
    allowed = F.col("rule").isin("bridge_telemetry", "bridge_command", "own_telemetry", "own_commands")
    return (
        requests.join(active, "username", "left")
        .withColumn("rule", rule)
        .withColumn("allowed", allowed)
        .select(*requests.columns, "allowed", "rule")
    )


def access_report(decisions: DataFrame) -> DataFrame:
    return decisions.groupBy("rule", "allowed").agg(F.count(F.lit(1)).alias("requests"))


def security_alerts(decisions: DataFrame) -> DataFrame:
    """Writes by active devices to topics that are not their own."""
    return decisions.filter("rule = 'foreign_write'")
