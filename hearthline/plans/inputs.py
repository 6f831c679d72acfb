"""Telemetry inputs derived row by row from the given tables.

Every function reads whole tables, so the inputs grow with them.  The SQL twins
are in ``input_sql``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "2024-01-31 00:00:00"
UNALIGNED_AS_OF = "2024-01-30 23:57:30"
BRIDGE = "bridge"
CLAIM_LIFE = "12 hours"


def device_id(number: str):
    return F.concat(
        F.lit("00000000-0000-4000-8000-"), F.lpad(F.expr(f"CAST({number} AS STRING)"), 12, "0")
    )


def user_id(number: str):
    return F.concat(F.lit("user-"), F.expr(f"CAST({number} AS STRING)"))


class Inputs:
    """The derived inputs of one data folder.  ``events`` may be a stream."""

    def __init__(self, spark: SparkSession, folder: str, events: DataFrame | None = None):
        self.spark = spark
        self.folder = folder
        self.events = self.table("events") if events is None else events

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def devices(self) -> DataFrame:
        as_of = F.lit(AS_OF).cast("timestamp_ntz")
        joined = self.table("customer").join(
            self.table("nation"), F.col("c_nationkey") == F.col("n_nationkey")
        )
        active = F.col("c_acctbal") >= 0
        age = F.expr("make_dt_interval(CAST(c_custkey % 60 AS INT))")
        return joined.select(
            F.col("c_custkey").alias("id"),
            device_id("c_custkey").alias("device_id"),
            F.md5(F.col("c_name").cast("binary")).alias("hashed_device_token"),
            user_id("c_nationkey").alias("user_id"),
            F.col("c_name").alias("name"),
            F.col("n_name").alias("location"),
            active.alias("is_active"),
            F.when(~active, as_of - age).alias("deactivated_at"),
            F.expr(
                "CASE WHEN c_custkey % 10 <> 0 THEN CAST(15 + c_custkey % 11 AS DOUBLE) END"
            ).alias("target_temperature"),
        )

    def raw(self) -> DataFrame:
        """JSON readings, eight of twenty of them faulty in one way each."""
        kind = F.expr("event_id % 20")
        temperature = F.expr(
            "(CAST(round(value * 100) AS BIGINT) % 14001 - 4000) / CAST(100 AS DOUBLE)"
        ).cast("string")
        full_id = device_id("user_id")
        id_field = (
            F.when(kind == 1, F.lit(""))
            .when(kind == 2, F.lit('"deviceId":"  ",'))
            .when(kind == 9, F.concat(F.lit('"deviceId":"'), full_id, F.lit('\\u0000",')))
            .otherwise(F.concat(F.lit('"deviceId":"'), full_id, F.lit('",')))
        )
        time = F.when(kind == 5, F.lit("bad")).otherwise(
            F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
        )
        current = (
            F.when(kind == 3, F.lit("null"))
            .when(kind == 6, F.lit('"21.5"'))
            .otherwise(temperature)
        )
        target = F.when(kind == 10, F.lit('"abc"')).otherwise(
            F.expr("CASE WHEN event_id % 3 = 0 THEN 'null' ELSE '21.0' END")
        )
        heating = F.expr("CASE WHEN event_id % 2 = 0 THEN 'true' ELSE 'false' END")
        data = F.when(kind == 4, F.lit("")).otherwise(
            F.concat(
                F.lit(',"data":{"currentTemperature":'), current,
                F.lit(',"targetTemperature":'), target,
                F.lit(',"heatingStatus":'), heating,
                F.lit("}"),
            )
        )
        extra = F.when(kind == 7, F.lit(',"extra":{"a":[1]}')).otherwise("")
        value = F.when(kind == 0, F.lit("not json")).otherwise(
            F.concat(F.lit("{"), id_field, F.lit('"timestamp":"'), time, F.lit('"'), data, extra, F.lit("}"))
        )
        return self.events.select("event_id", value.alias("value"), F.col("event_id").alias("arrival"))

    def points(self) -> DataFrame:
        return self.events.select(
            device_id("user_id").alias("device_id"),
            "ts",
            F.col("value").alias("current_temperature"),
            F.expr("CASE WHEN event_id % 3 <> 0 THEN CAST(21 AS DOUBLE) END").alias("target_temperature"),
            F.expr("CASE WHEN event_id % 2 = 0 THEN 1 ELSE 0 END").alias("heating_status"),
            F.col("event_id").alias("arrival"),
        )

    def writes(self) -> DataFrame:
        """Points on whole days, so that many writes share a point."""
        return self.points().withColumn("ts", F.date_trunc("DAY", "ts").cast("timestamp_ntz"))

    def replayed_points(self) -> DataFrame:
        """Points of devices that were offline at times and sent some readings later."""
        behind = F.expr(
            "make_dt_interval(0, 0, CAST(CASE WHEN event_id % 7 = 0 THEN event_id % 500 ELSE 0 END AS INT))"
        )
        return self.events.select(
            device_id("user_id").alias("device_id"),
            (F.col("ts") - behind).alias("ts"),
            F.col("event_id").alias("arrival"),
            F.col("ts").alias("arrival_ts"),
        )

    def views(self) -> DataFrame:
        return self.events.filter("event_type = 'view'").select(
            F.col("event_id").alias("id"),
            user_id("user_id % 25").alias("user_id"),
            device_id("CAST(get_json_object(props, '$.k') AS BIGINT) % 10").alias("device_id"),
            F.col("ts").alias("viewed_at"),
        )

    def _crowded(self):
        """Instants within a quarter of an hour, so that gaps are seconds."""
        return F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, event_id * 37 % 900)")

    def dense_views(self) -> DataFrame:
        views = self.events.filter("event_type = 'view'").withColumn("ts", self._crowded())
        return Inputs(self.spark, self.folder, views).views()

    def dense_points(self) -> DataFrame:
        return Inputs(self.spark, self.folder, self.events.withColumn("ts", self._crowded())).points()

    def faulty_views(self) -> DataFrame:
        """Views some of which have blank or over-long ids."""
        faulty = lambda column, k: (
            F.when(F.col("id") % 7 == k, F.lit(" \t"))
            .when(F.col("id") % 11 == k, F.repeat(F.lit("u"), F.lit(101)))
            .when(F.col("id") % 13 == k, F.repeat(F.lit("u"), F.lit(100)))
            .when(F.col("id") % 17 == k, F.lit(None).cast("string"))
            .otherwise(F.col(column))
        )
        return self.views().withColumns({"user_id": faulty("user_id", 0), "device_id": faulty("device_id", 1)})

    def messages(self) -> DataFrame:
        device = device_id("user_id")
        kind = F.expr("event_id % 5")
        topic = (
            F.when(kind == 1, F.concat(F.lit("iot/telemetry/"), device, F.lit("/x")))
            .when(kind == 2, F.lit("iot/telemetry/"))
            .when(kind == 3, F.concat(F.lit("iot/other/"), device))
            .otherwise(F.concat(F.lit("iot/telemetry/"), device))
        )
        return self.events.select(
            "event_id",
            "ts",
            topic.alias("topic"),
            F.col("props").alias("payload"),
            F.expr("event_id % 40 <> 0").alias("delivered"),
        )

    def access_requests(self) -> DataFrame:
        device = device_id("user_id")
        other = device_id("user_id + 1")
        place = F.expr("CAST(floor(event_id / 4) AS BIGINT) % 6")
        return self.events.select(
            "event_id",
            F.when(F.expr("event_id % 7 = 0"), F.lit(BRIDGE)).otherwise(device).alias("username"),
            F.expr("CASE event_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 4 ELSE 99 END").alias("acc"),
            F.when(place == 0, F.concat(F.lit("iot/telemetry/"), device))
            .when(place == 1, F.concat(F.lit("iot/telemetry/"), other))
            .when(place == 2, F.concat(F.lit("devices/"), device, F.lit("/commands")))
            .when(place == 3, F.concat(F.lit("devices/"), device, F.lit("/commands/")))
            .when(place == 4, F.lit("devices//commands"))
            .alias("topic"),
        )

    @staticmethod
    def _code():
        return F.expr("concat('100-1', lpad(CAST(event_id % 20 AS STRING), 2, '0'))")

    def codes(self) -> DataFrame:
        return self.events.filter("event_type = 'signup'").select(
            F.col("event_id").alias("issue_id"),
            self._code().alias("code"),
            user_id("user_id % 25").alias("user_id"),
            F.col("ts").alias("issued_at"),
        )

    def claims(self) -> DataFrame:
        """Claims; some are not written in the code format."""
        code = F.when(F.expr("event_id % 13 = 0"), F.regexp_replace(self._code(), "-", ""))
        return self.events.filter("event_type = 'purchase'").select(
            F.col("event_id").alias("claim_id"),
            code.otherwise(self._code()).alias("code"),
            F.col("ts").alias("claimed_at"),
        )

    def claim_identities(self) -> DataFrame:
        """Id and token made for each claim."""
        return self.events.filter("event_type = 'purchase'").select(
            F.col("event_id").alias("claim_id"),
            F.expr("event_id + 1000000000").alias("id"),
            device_id("event_id + 500000000000").alias("device_id"),
            F.md5(F.expr("CAST(CAST(event_id AS STRING) AS BINARY)")).alias("hashed_device_token"),
        )

    def identity_events(self) -> DataFrame:
        return self.events.filter("event_type = 'error'").select(
            F.expr(
                "CASE event_id % 4 WHEN 0 THEN 'DELETE_ACCOUNT' WHEN 1 THEN 'DELETE_ACCOUNT_ADMIN' "
                "WHEN 2 THEN 'REGISTER' END"
            ).alias("type"),
            F.when(F.expr("event_id % 11 = 0"), F.lit(" "))
            .otherwise(user_id("user_id % 25"))
            .alias("user_id"),
            F.col("ts").alias("time"),
        )

    def commands(self) -> DataFrame:
        owners = self.table("customer").select("c_custkey", "c_nationkey")
        third = F.expr("CAST(floor(event_id / 6) AS BIGINT)")
        clicks = self.events.filter("event_type = 'click'")
        return clicks.join(owners, F.col("user_id") == F.col("c_custkey")).select(
            device_id("user_id").alias("device_id"),
            F.when(third % 3 == 2, F.lit("user-none")).otherwise(user_id("c_nationkey")).alias("user_id"),
            F.expr(
                "CASE event_id % 6 WHEN 0 THEN '21' WHEN 1 THEN '-40' WHEN 2 THEN '100.5' "
                "WHEN 3 THEN 'abc' WHEN 5 THEN 'NaN' END"
            ).alias("value"),
            F.when(third % 4 == 0, F.concat(F.lit("Room "), F.col("event_id").cast("string")))
            .when(third % 4 == 1, F.lit("  "))
            .when(third % 4 == 3, F.repeat(F.lit("x"), F.lit(51)))
            .alias("name"),
            F.col("event_id").alias("seq"),
        )

    def device_versions(self) -> DataFrame:
        """What devices were called and set to: as in the registry from the third day on, renamed by each click."""
        loaded = self.devices().select(
            "device_id",
            F.lit("2024-01-03 00:00:00").cast("timestamp_ntz").alias("valid_from"),
            F.lit(-1).cast("long").alias("seq"),
            "name",
            F.coalesce("target_temperature", F.lit(0.0)).alias("target_temperature"),
        )
        renamed = self.events.filter("event_type = 'click'").select(
            device_id("user_id").alias("device_id"),
            F.col("ts").alias("valid_from"),
            F.col("event_id").alias("seq"),
            F.concat(F.lit("Room "), F.col("event_id").cast("string")).alias("name"),
            F.expr("CAST(15 + event_id % 10 AS DOUBLE)").alias("target_temperature"),
        )
        return loaded.unionByName(renamed)

    def purges(self) -> DataFrame:
        """Purge events: those of expired devices, and faulty ones of other customers."""
        cutoff = F.lit(AS_OF).cast("timestamp_ntz") - F.expr("INTERVAL '30' DAY")
        key, device = F.col("id") % 50, F.col("device_id")
        event = lambda name, action: F.concat(
            F.lit('{"deviceId":"'), name, F.lit(f'","action":"{action}"}}')
        )
        value = (
            F.when(key == 7, F.lit("not json"))
            .when(key == 8, event(device, "purge"))
            .when(key == 9, event(F.concat(F.lit("dev-"), F.col("id").cast("string")), "PURGE"))
            .when(
                ~F.col("is_active") & (F.col("deactivated_at") < cutoff), event(device, "PURGE")
            )
        )
        at = F.lit("2024-01-18 00:00:00").cast("timestamp_ntz") + F.expr(
            "make_dt_interval(CAST(id % 10 AS INT))"
        )
        return self.devices().select(value.alias("value"), at.alias("purge_ts")).filter("value IS NOT NULL")
