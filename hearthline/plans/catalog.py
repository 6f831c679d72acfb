"""Every operator as a query over the given tables, with its SQL twin for DuckDB."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import streaming as S
from ..operators import access, claims, devices, ingest, series, tables, views
from ..session import shared_dir
from ..sources.events import read_events, write_events
from ..sources.points import purge_stored, read_points, upsert_points
from ..sources.registry import change_registry, read_registry, write_registry
from . import flows
from .input_sql import _device, over
from .inputs import AS_OF, BRIDGE, CLAIM_LIFE, UNALIGNED_AS_OF, Inputs


@dataclass(frozen=True)
class Query:
    run: Callable[[Inputs], DataFrame]
    sql: str | None


CATALOG: dict[str, Query] = {}


def query(sql: str | None = None, name: str | None = None):
    def register(run: Callable[[Inputs], DataFrame]):
        CATALOG[name or run.__name__] = Query(run, sql)
        return run

    return register


def plain(df: DataFrame) -> DataFrame:
    """Instants as UTC wall-clock timestamps."""
    return df.select(
        *[
            F.to_utc_timestamp(f.name, F.current_timezone()).cast("timestamp_ntz").alias(f.name)
            if f.dataType.typeName() == "timestamp"
            else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def instants(df: DataFrame, *columns: str) -> DataFrame:
    """UTC wall-clock timestamps as instants, which watermarks need."""
    return df.withColumns(
        {c: F.from_utc_timestamp(F.col(c).cast("timestamp"), F.current_timezone()) for c in columns}
    )


# --- ingest ---------------------------------------------------------------

_EVENT = "event_id, device_id, ts, current_temperature, target_temperature, heating"


@query(over("parsed", "SELECT event_id, valid FROM parsed"))
def parse_telemetry(x: Inputs) -> DataFrame:
    return ingest.parse_telemetry(x.raw()).select("event_id", "valid")


@query(over("parsed", f"SELECT {_EVENT} FROM parsed WHERE valid"))
def valid_telemetry(x: Inputs) -> DataFrame:
    events = ingest.valid_telemetry(ingest.parse_telemetry(x.raw()))
    return plain(events.drop("value", "arrival"))


@query(over("parsed", "SELECT event_id, value FROM parsed WHERE NOT valid"))
def invalid_telemetry(x: Inputs) -> DataFrame:
    return ingest.invalid_telemetry(ingest.parse_telemetry(x.raw())).select("event_id", "value")


@query(over("parsed", "SELECT value FROM parsed WHERE NOT valid"))
def dead_letters(x: Inputs) -> DataFrame:
    return ingest.dead_letters(ingest.parse_telemetry(x.raw()))


@query(
    over(
        "parsed",
        "SELECT count(*) FILTER (WHERE valid) AS telemetry_valid, "
        "count(*) FILTER (WHERE NOT valid) AS telemetry_invalid FROM parsed",
    )
)
def validity_counts(x: Inputs) -> DataFrame:
    return ingest.validity_counts(ingest.parse_telemetry(x.raw()))


_ENCODED = """'{"deviceId":"' || device_id || '","timestamp":"'
    || strftime(ts, '%Y-%m-%dT%H:%M:%S')
    || CASE WHEN epoch_us(ts) % 1000000 = 0 THEN ''
            WHEN epoch_us(ts) % 1000 = 0 THEN strftime(ts, '.%g') ELSE strftime(ts, '.%f') END
    || 'Z","data":{"currentTemperature":' || CAST(current_temperature AS VARCHAR)
    || ',"targetTemperature":' || coalesce(CAST(target_temperature AS VARCHAR), 'null')
    || ',"heatingStatus":' || CASE WHEN heating THEN 'true' ELSE 'false' END || '}}'"""


@query(over("parsed", f"SELECT event_id, {_ENCODED} AS value FROM parsed WHERE valid"))
def encode_telemetry(x: Inputs) -> DataFrame:
    events = ingest.valid_telemetry(ingest.parse_telemetry(x.raw()))
    return ingest.encode_telemetry(events).select("event_id", "value")


@query(over("parsed", f"SELECT device_id AS key, {_ENCODED} AS value, ts FROM parsed WHERE valid"))
def keyed_records(x: Inputs) -> DataFrame:
    events = ingest.valid_telemetry(ingest.parse_telemetry(x.raw()))
    return plain(ingest.keyed_records(events))


_TO_POINT = """SELECT device_id, date_trunc('millisecond', ts) AS ts, current_temperature,
    target_temperature, CASE WHEN heating THEN 1 ELSE 0 END AS heating_status, arrival
    FROM parsed WHERE valid"""


@query(over("parsed", _TO_POINT))
def to_points(x: Inputs) -> DataFrame:
    return plain(ingest.to_points(ingest.valid_telemetry(ingest.parse_telemetry(x.raw()))))


@query(over("purge_targets", "SELECT device_id, purge_ts FROM purge_targets"))
def parse_purges(x: Inputs) -> DataFrame:
    return ingest.parse_purges(x.purges())


@query(
    over(
        "purge_targets",
        "SELECT device_id, purge_ts, regexp_full_match(device_id, '[0-9a-fA-F-]{36}') AS device_id_ok "
        "FROM purge_targets",
    )
)
def device_id_guard(x: Inputs) -> DataFrame:
    return ingest.device_id_guard(ingest.parse_purges(x.purges()))


@query(over("routed", "SELECT event_id, key, value, route FROM routed"))
def route_messages(x: Inputs) -> DataFrame:
    return ingest.route_messages(x.messages()).select("event_id", "key", "value", "route")


@query(
    over("routed", "SELECT '/topic/device.' || key AS destination, value AS payload FROM routed WHERE key <> ''")
)
def live_routes(x: Inputs) -> DataFrame:
    return ingest.live_routes(ingest.route_messages(x.messages()))


_METRICS = """count(*) AS received, count(*) FILTER (WHERE route = 'invalid') AS invalid_topics,
    count(*) FILTER (WHERE route = 'telemetry' AND delivered) AS sent,
    count(*) FILTER (WHERE route = 'telemetry' AND NOT delivered) AS failed,
    round(count(*) FILTER (WHERE route = 'telemetry' AND delivered)
          / CAST(greatest(count(*), 1) AS DOUBLE) * 100, 2) AS success_rate"""


@query(over("routed", f"SELECT {_METRICS} FROM routed"))
def ingest_metrics(x: Inputs) -> DataFrame:
    return ingest.ingest_metrics(x.messages())


@query(over("routed", f"SELECT date_trunc('day', ts) AS window_start, {_METRICS} FROM routed GROUP BY 1"))
def ingest_metrics_daily(x: Inputs) -> DataFrame:
    return ingest.ingest_metrics(x.messages(), "1 day")


@query(over("routed", "SELECT key AS device_id, count(*) AS messages FROM routed WHERE key <> '' GROUP BY 1"))
def devices_seen(x: Inputs) -> DataFrame:
    return ingest.devices_seen(x.messages())


@query(over("routed", "SELECT count(DISTINCT key) AS devices FROM routed WHERE key <> ''"))
def devices_seen_count(x: Inputs) -> DataFrame:
    return ingest.devices_seen_count(x.messages())


@query(over("routed", "SELECT count(DISTINCT key) AS devices, true AS close FROM routed WHERE key <> ''"))
def devices_seen_approximate(x: Inputs) -> DataFrame:
    """Whether the sketch's estimate is within 5 % of the exact number, or 1 of a small one."""
    exact = ingest.devices_seen_count(x.messages())
    about = ingest.devices_seen_count(x.messages(), approximate=True).select(F.col("devices").alias("about"))
    return exact.crossJoin(about).select("devices", _close("about", "devices"))


def _close(about: str, exact: str):
    return (F.abs(F.col(about) - F.col(exact)) <= F.greatest(F.lit(1.0), 0.05 * F.col(exact))).alias("close")


@query(
    f"""SELECT strftime(ts, '%Y-%m-%d') AS day, count(DISTINCT {_device('user_id')}) AS devices, true AS close FROM events
        WHERE event_id % 5 IN (0, 4) GROUP BY 1"""
)
def stream_devices_seen(x: Inputs) -> DataFrame:
    """Sketches that a stream keeps by batch and day, merged by day, against exact numbers."""
    folder, checkpoint = _log(x, "seen")
    S.stream_devices_seen(stream_of(x).messages(), folder, checkpoint, S.AVAILABLE_NOW).awaitTermination()
    about = S.devices_seen_by_day(x.spark, folder).select("day", F.col("devices").alias("about"))
    seen = ingest.route_messages(x.messages()).filter("route = 'telemetry' AND key <> ''")
    exact = seen.groupBy(F.to_date("ts").alias("day")).agg(F.count_distinct("key").alias("devices"))
    return exact.join(about, "day", "left").select(F.col("day").cast("string").alias("day"), "devices", F.coalesce(_close("about", "devices"), F.lit(False)).alias("close"))


# --- series ---------------------------------------------------------------


@query(
    over(
        "writes",
        """SELECT device_id, ts,
           arg_max(current_temperature, arrival) FILTER (WHERE current_temperature IS NOT NULL) AS current_temperature,
           arg_max(target_temperature, arrival) FILTER (WHERE target_temperature IS NOT NULL) AS target_temperature,
           arg_max(heating_status, arrival) FILTER (WHERE heating_status IS NOT NULL) AS heating_status,
           max(arrival) AS arrival FROM writes GROUP BY device_id, ts""",
    )
)
def merge_points(x: Inputs) -> DataFrame:
    return series.merge_points(x.writes())


# The mean of an exact sum, so that it does not depend on the order of the readings.
_MEAN = """floor(sum(current_temperature::DECIMAL(28, 6))::DOUBLE / count(current_temperature)
               * 100.0::DOUBLE + 0.5::DOUBLE) / 100.0::DOUBLE"""


def _history_sql(width: str, start: str | None = None, stop: str | None = None) -> str:
    bounds = [f"ts >= {start}"] if start else []
    bounds += [f"ts < {stop}"] if stop else []
    end = f"time_bucket(INTERVAL '{width}', ts, TIMESTAMP '1970-01-01') + INTERVAL '{width}'"
    return f"""SELECT device_id, {f'least({end}, {stop})' if stop else end} AS "timestamp",
        {_MEAN} AS temperature
        FROM points {'WHERE ' + ' AND '.join(bounds) if bounds else ''}
        GROUP BY device_id, {end}"""


def _history_query(name: str, range_: str, span: str, width: str, as_of: str) -> None:
    stop = f"TIMESTAMP '{as_of}'"
    sql = over("points", _history_sql(width, f"{stop} - INTERVAL '{span}'", stop))
    query(sql, name)(lambda x: series.telemetry_history(x.points(), range_, as_of))


_history_query("telemetry_history_24h", "-24h", "24 hours", "15 minutes", AS_OF)
_history_query("telemetry_history_6h", "-6h", "6 hours", "5 minutes", AS_OF)
_history_query("telemetry_history_1h", "-1h", "1 hour", "1 minute", AS_OF)
_history_query("telemetry_history_unaligned", "-24h", "24 hours", "15 minutes", UNALIGNED_AS_OF)


@query(over("points", _history_sql("15 minutes")))
def bucket_means(x: Inputs) -> DataFrame:
    """The 15-minute history of every device over all of its points."""
    return series.bucket_means(x.points(), "15 minutes")


@query(
    over(
        "parsed",
        """SELECT device_id, time_bucket(INTERVAL '15 minutes', ts, TIMESTAMP '1970-01-01')
               + INTERVAL '15 minutes' AS "timestamp",
               """ + _MEAN + """ AS temperature
           FROM (SELECT device_id, date_trunc('millisecond', ts) AS ts,
                        arg_max(current_temperature, arrival) AS current_temperature
                 FROM parsed WHERE valid GROUP BY 1, 2) p
           GROUP BY 1, 2""",
    )
)
def raw_to_history(x: Inputs) -> DataFrame:
    """Raw JSON to the 15-minute history of every device."""
    return plain(flows.raw_to_history(x.raw(), "15 minutes"))


_RANGE = "CASE event_id % 5 WHEN 0 THEN '-24h' WHEN 1 THEN '-6h' WHEN 2 THEN '-1h' WHEN 3 THEN '-7d' END"


@query(
    f"""SELECT event_id, range, TIMESTAMP '{AS_OF}' AS stop,
            TIMESTAMP '{AS_OF}' - CASE range WHEN '-24h' THEN INTERVAL 24 HOUR
                                             WHEN '-6h' THEN INTERVAL 6 HOUR
                                             ELSE INTERVAL 1 HOUR END AS start,
            CASE range WHEN '-24h' THEN '15 minutes' WHEN '-6h' THEN '5 minutes'
                       ELSE '1 minute' END AS bucket
        FROM (SELECT event_id, {_RANGE} AS range FROM events) r"""
)
def history_ranges(x: Inputs) -> DataFrame:
    requests = x.events.select("event_id", F.expr(_RANGE).alias("range"))
    return series.history_ranges(requests, AS_OF)


def _last_n_sql(n: int) -> str:
    return over(
        "points",
        f"SELECT * FROM points QUALIFY row_number() OVER (PARTITION BY device_id ORDER BY arrival DESC) <= {n}",
    )


query(_last_n_sql(300), "last_n_detail")(lambda x: series.last_n(x.points(), series.DETAIL_BUFFER))
query(_last_n_sql(200), "last_n_dashboard")(lambda x: series.last_n(x.points(), series.DASHBOARD_BUFFER))
query(_last_n_sql(5), "last_n_five")(lambda x: series.last_n(x.points(), 5))


@query(
    over(
        "points",
        "SELECT * FROM points QUALIFY row_number() OVER (PARTITION BY device_id ORDER BY arrival DESC) = 1",
    )
)
def latest_readings(x: Inputs) -> DataFrame:
    return series.latest_readings(x.points())


_LOADED = "2024-01-16 00:00:00"


@query(
    over(
        "points",
        f"""SELECT device_id, "timestamp", temperature, section, arrival FROM (
              SELECT h.*, 0 AS section, CAST(NULL AS BIGINT) AS arrival FROM ({_history_sql("15 minutes", None, f"TIMESTAMP '{_LOADED}'")}) h
              UNION ALL
              SELECT device_id, ts, current_temperature, 1, arrival FROM points WHERE ts >= TIMESTAMP '{_LOADED}') u
            QUALIFY row_number() OVER (PARTITION BY device_id
              ORDER BY section DESC, arrival DESC NULLS LAST, "timestamp" DESC) <= 60""",
    )
)
def history_with_tail(x: Inputs) -> DataFrame:
    points = x.points()
    loaded = F.lit(_LOADED).cast("timestamp_ntz")
    history = series.bucket_means(points, "15 minutes", stop=loaded)
    return series.history_with_tail(history, points.filter(F.col("ts") >= loaded), 60)


_PURGED = """SELECT p.* FROM points p LEFT JOIN latest_purges d ON p.device_id = d.device_id
    WHERE d.device_id IS NULL OR p.ts > d.purge_ts"""


@query(over("points latest_purges", _PURGED))
def purge_points(x: Inputs) -> DataFrame:
    """Purge events all the way to the points that survive them."""
    checked = ingest.device_id_guard(ingest.parse_purges(x.purges()))
    return series.purge_points(x.points(), checked.filter("device_id_ok"))


@query(
    over(
        "replayed_points latest_purges",
        """SELECT p.* FROM replayed_points p LEFT JOIN latest_purges d ON p.device_id = d.device_id
           WHERE d.device_id IS NULL OR p.ts > d.purge_ts OR p.arrival_ts > d.purge_ts""",
    )
)
def purge_points_by_arrival(x: Inputs) -> DataFrame:
    checked = ingest.device_id_guard(ingest.parse_purges(x.purges()))
    return series.purge_points(x.replayed_points(), checked.filter("device_id_ok"), "arrival_ts")


@query(
    over(
        "points",
        f"""SELECT device_id, max(ts) AS last_seen,
            TIMESTAMP '{UNALIGNED_AS_OF}' - max(ts) > INTERVAL 6 HOUR AS stale FROM points GROUP BY device_id""",
    )
)
def stale_devices_6h(x: Inputs) -> DataFrame:
    return series.stale_devices(x.points(), UNALIGNED_AS_OF, "6 hours")


@query(
    over(
        "points",
        f"""SELECT device_id, max(ts) AS last_seen,
            TIMESTAMP '{UNALIGNED_AS_OF}' - max(ts) > INTERVAL 10 SECOND AS stale FROM points GROUP BY device_id""",
    )
)
def stale_devices(x: Inputs) -> DataFrame:
    return series.stale_devices(x.points(), UNALIGNED_AS_OF)


def _intervals_sql(gap: str, points: str = "points") -> str:
    return f"""SELECT device_id, min(ts) AS online_from, max(ts) AS last_seen, count(*) AS readings,
            max(ts) + INTERVAL '{gap}' AS stale_from
        FROM (SELECT *, sum(fresh) OVER (PARTITION BY device_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run
              FROM (SELECT device_id, ts,
                      CASE WHEN ts - lag(ts) OVER (PARTITION BY device_id ORDER BY ts) <= INTERVAL '{gap}'
                           THEN 0 ELSE 1 END AS fresh FROM {points}) f) r
        GROUP BY device_id, run"""


query(over("points", _intervals_sql("10 seconds")), "online_intervals")(
    lambda x: series.online_intervals(x.points())
)
query(over("dense_points", _intervals_sql("10 seconds", "dense_points")), "online_intervals_dense")(
    lambda x: series.online_intervals(x.dense_points())
)
query(over("points", _intervals_sql("3 hours")), "online_intervals_3h")(
    lambda x: series.online_intervals(x.points(), "3 hours", "1 day")
)


@query(
    over(
        "points",
        f"SELECT max(ts) AS last_message, TIMESTAMP '{UNALIGNED_AS_OF}' - max(ts) < INTERVAL 120 SECOND AS healthy FROM points",
    )
)
def ingest_health(x: Inputs) -> DataFrame:
    return series.ingest_health(x.points(), UNALIGNED_AS_OF)


_LATE = """SELECT *, epoch_us(arrival_ts) - epoch_us(ts) AS lag_micros,
    coalesce(seen_until - ts > INTERVAL '10 minutes', false) AS late
    FROM (SELECT *, max(ts) OVER (PARTITION BY device_id ORDER BY arrival
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen_until FROM replayed_points) r"""


@query(over("replayed_points", _LATE))
def late_arrivals(x: Inputs) -> DataFrame:
    return series.late_arrivals(x.replayed_points(), "10 minutes", slice_rows=1000)


# --- devices --------------------------------------------------------------


@query(over("active", "SELECT * FROM active"))
def active_devices(x: Inputs) -> DataFrame:
    return devices.active_devices(x.devices())


@query(over("active commands", "SELECT * FROM active WHERE device_id IN (SELECT device_id FROM commands)"))
def active_devices_by_id(x: Inputs) -> DataFrame:
    return devices.active_devices(x.devices(), x.commands(), ["device_id"])


@query(
    over(
        "active commands",
        "SELECT * FROM active WHERE (device_id, user_id) IN (SELECT (device_id, user_id) FROM commands)",
    )
)
def active_devices_by_id_and_user(x: Inputs) -> DataFrame:
    return devices.active_devices(x.devices(), x.commands(), ["device_id", "user_id"])


@query(over("active gone_users", "SELECT * FROM active WHERE user_id IN (SELECT user_id FROM gone_users)"))
def active_devices_by_user(x: Inputs) -> DataFrame:
    return devices.active_devices(x.devices(), devices.deleted_users(x.identity_events()), ["user_id"])


@query(over("devices views", "SELECT * FROM devices WHERE device_id IN (SELECT device_id FROM views)"))
def find_devices(x: Inputs) -> DataFrame:
    return devices.find_devices(x.devices(), x.views(), ["device_id"])


@query(
    over(
        "devices",
        "SELECT device_id, name, location, is_active, deactivated_at, target_temperature FROM devices",
    )
)
def public_devices(x: Inputs) -> DataFrame:
    return devices.public_devices(x.devices())


@query(over("checked_commands", "SELECT * FROM checked_commands"))
def validate_temperature(x: Inputs) -> DataFrame:
    return devices.validate_temperature(x.commands())


@query(over("checked_names", "SELECT * FROM checked_names"))
def validate_rename(x: Inputs) -> DataFrame:
    return devices.validate_rename(x.commands())


@query(over("gone_users", "SELECT user_id FROM gone_users"))
def deleted_users(x: Inputs) -> DataFrame:
    return devices.deleted_users(x.identity_events())


_ENRICHED = """SELECT p.*, d.name, d.location, d.target_temperature AS stored_target
    FROM points p LEFT JOIN devices d ON p.device_id = d.device_id"""


@query(over("points devices", _ENRICHED))
def enrich(x: Inputs) -> DataFrame:
    return devices.enrich(x.points(), x.devices())


@query(
    over(
        "points devices",
        f"""SELECT *, CASE WHEN heating_status = 1 AND current_temperature < effective_target - 0.1 THEN 'HEATING'
                           WHEN heating_status = 1 AND current_temperature > effective_target + 0.1 THEN 'COOLING'
                           ELSE 'IDLE' END AS status
            FROM (SELECT *, coalesce(target_temperature,
                    CASE WHEN stored_target BETWEEN -40 AND 100 THEN stored_target END, 22.0) AS effective_target
                  FROM ({_ENRICHED}) e) t""",
    )
)
def hvac_status(x: Inputs) -> DataFrame:
    return devices.hvac_status(devices.enrich(x.points(), x.devices()))


_OWNED = "(device_id, user_id) IN (SELECT (device_id, user_id) FROM active)"


@query(over("commands active", f"SELECT * FROM commands WHERE {_OWNED}"))
def owned_requests(x: Inputs) -> DataFrame:
    return devices.owned_requests(x.commands(), x.devices())


@query(over("commands active", f"SELECT * FROM commands WHERE NOT {_OWNED}"))
def denied_requests(x: Inputs) -> DataFrame:
    return devices.denied_requests(x.commands(), x.devices())


def _deactivated_sql(names: str, chosen: str) -> str:
    return over(
        names,
        f"""SELECT * REPLACE (is_active AND NOT ({chosen}) AS is_active,
              CASE WHEN is_active AND ({chosen}) THEN TIMESTAMP '{AS_OF}' ELSE deactivated_at END AS deactivated_at)
            FROM devices""",
    )


@query(
    _deactivated_sql(
        "devices commands", "(device_id, user_id) IN (SELECT (device_id, user_id) FROM commands)"
    )
)
def soft_delete(x: Inputs) -> DataFrame:
    return devices.soft_delete(x.devices(), x.commands(), AS_OF)


@query(
    over(
        "commands active",
        f"""SELECT device_id, user_id, CASE WHEN {_OWNED} THEN 'DELETED' ELSE 'NOT_FOUND' END AS outcome
            FROM (SELECT DISTINCT device_id, user_id FROM commands) c""",
    )
)
def soft_delete_outcomes(x: Inputs) -> DataFrame:
    return devices.soft_delete_outcomes(x.devices(), x.commands())


@query(_deactivated_sql("devices gone_users", "user_id IN (SELECT user_id FROM gone_users)"))
def deactivate_users(x: Inputs) -> DataFrame:
    return devices.deactivate_users(x.devices(), devices.deleted_users(x.identity_events()), AS_OF)


@query(
    over(
        "devices checked_commands checked_names",
        """SELECT d.* REPLACE (
               CASE WHEN d.is_active THEN coalesce(t.temperature, d.target_temperature)
                    ELSE d.target_temperature END AS target_temperature,
               CASE WHEN d.is_active THEN coalesce(n.name, d.name) ELSE d.name END AS name)
           FROM devices d
           LEFT JOIN (SELECT device_id, user_id, arg_max(temperature, seq) AS temperature
                      FROM checked_commands WHERE ok GROUP BY 1, 2) t
                  ON t.device_id = d.device_id AND t.user_id = d.user_id
           LEFT JOIN (SELECT device_id, user_id, arg_max(name, seq) AS name
                      FROM checked_names WHERE ok GROUP BY 1, 2) n
                  ON n.device_id = d.device_id AND n.user_id = d.user_id""",
    )
)
def apply_commands(x: Inputs) -> DataFrame:
    return devices.apply_commands(x.devices(), x.commands())


@query(
    over(
        "checked_commands commands active",
        f"""SELECT 'devices/' || device_id || '/commands' AS topic,
                   '{{"command": "' || command || '", "value": ' || value || '}}' AS payload,
                   1 AS qos, command = 'set_target_temp' AS retained
            FROM (SELECT device_id, 'set_target_temp' AS command, CAST(temperature AS VARCHAR) AS value
                  FROM checked_commands WHERE ok AND {_OWNED}
                  UNION ALL
                  SELECT DISTINCT device_id, 'reset_device', '"' || substr(device_id, 1, 8) || '"'
                  FROM commands WHERE {_OWNED}) c""",
    )
)
def command_events(x: Inputs) -> DataFrame:
    commands, table = x.commands(), x.devices()
    requests = devices.temperature_requests(commands, table).unionByName(
        devices.reset_requests(commands, table)
    )
    return devices.command_events(requests)


@query(over("expired", "SELECT * FROM expired"))
def expired_devices(x: Inputs) -> DataFrame:
    return devices.expired_devices(x.devices(), AS_OF)


@query(over("devices expired", "SELECT * FROM devices WHERE id NOT IN (SELECT id FROM expired)"))
def retain_devices(x: Inputs) -> DataFrame:
    return devices.retain_devices(x.devices(), AS_OF)


@query(
    over(
        "expired",
        """SELECT device_id AS key, '{"deviceId":"' || device_id || '","action":"PURGE"}' AS value FROM expired""",
    )
)
def purge_events(x: Inputs) -> DataFrame:
    return devices.purge_events(devices.expired_devices(x.devices(), AS_OF))


_PURGE_ALL = f"""SELECT * FROM points p WHERE NOT EXISTS (
    SELECT 1 FROM expired e WHERE e.device_id = p.device_id AND p.ts <= TIMESTAMP '{UNALIGNED_AS_OF}')"""


@query(over("points expired", _PURGE_ALL))
def retention_purge(x: Inputs) -> DataFrame:
    """Retention end to end: expired devices, their PURGE events, the points left after them."""
    events = flows.retention(x.views(), x.devices(), AS_OF).purges
    at = F.lit(UNALIGNED_AS_OF).cast("timestamp_ntz")
    checked = ingest.device_id_guard(ingest.parse_purges(events.select("value")))
    return series.purge_points(x.points(), checked.filter("device_id_ok").withColumn("purge_ts", at))


@query(over("views", f"SELECT * FROM views WHERE viewed_at >= TIMESTAMP '{AS_OF}' - INTERVAL 10 DAY"))
def retention_views(x: Inputs) -> DataFrame:
    """The views that the retention run keeps."""
    return flows.retention(x.views(), x.devices(), AS_OF, 10).views


@query(
    over(
        "devices",
        f"""SELECT * FROM devices
            WHERE is_active OR deactivated_at IS NULL OR deactivated_at >= TIMESTAMP '{AS_OF}' - INTERVAL 10 DAY""",
    )
)
def retention_devices(x: Inputs) -> DataFrame:
    """The devices that the retention run keeps."""
    return flows.retention(x.views(), x.devices(), AS_OF, 10).devices


_CLAIMED = """FROM resolved r JOIN claim_identities i ON r.claim_id = i.claim_id WHERE status = 'CLAIMED'"""
_NEW = f"""SELECT i.id, i.device_id, i.hashed_device_token, r.user_id,
    'New Device ' || substr(i.device_id, 1, 4) AS name, CAST(NULL AS VARCHAR) AS location, true AS is_active,
    CAST(NULL AS TIMESTAMP) AS deactivated_at, CAST(20 AS DOUBLE) AS target_temperature {_CLAIMED}"""


def _claimed(x: Inputs) -> DataFrame:
    resolved = claims.resolve_claims(x.codes(), claims.valid_claims(x.claims()), CLAIM_LIFE)
    return claims.claimed_devices(resolved, x.claim_identities())


@query(over("resolved claim_identities", _NEW))
def new_devices(x: Inputs) -> DataFrame:
    return devices.new_devices(x.devices(), _claimed(x))


@query(over("devices resolved claim_identities", f"SELECT * FROM devices UNION ALL {_NEW}"))
def provision(x: Inputs) -> DataFrame:
    return devices.provision(x.devices(), _claimed(x))


_ASKED_RANGE = "CASE seq % 5 WHEN 0 THEN '-24h' WHEN 1 THEN '-6h' WHEN 2 THEN '-1h' WHEN 3 THEN '-7d' END"


def _asked_history_sql(range_: str, span: str, width: str) -> str:
    stop = f"TIMESTAMP '{AS_OF}'"
    history = _history_sql(width, f"{stop} - INTERVAL '{span}'", stop)
    return f"""SELECT h.*, '{range_}' AS range FROM ({history}) h
        WHERE device_id IN (SELECT device_id FROM asked WHERE range = '{range_}')"""


@query(
    over(
        "points commands active",
        " UNION ALL ".join(
            _asked_history_sql(*args)
            for args in [
                ("-24h", "24 hours", "15 minutes"),
                ("-6h", "6 hours", "5 minutes"),
                ("-1h", "1 hour", "1 minute"),
            ]
        ),
        f"""asked AS (SELECT DISTINCT device_id, CASE WHEN {_ASKED_RANGE} IN ('-24h', '-6h')
                      THEN {_ASKED_RANGE} ELSE '-1h' END AS range FROM commands WHERE {_OWNED})""",
    )
)
def requested_history(x: Inputs) -> DataFrame:
    """History as asked for: by owners of active devices, each over the range they name."""
    requests = x.commands().withColumn("range", F.expr(_ASKED_RANGE))
    return flows.requested_history(x.points(), x.devices(), requests, AS_OF)


# --- views ----------------------------------------------------------------


@query(over("views", "SELECT * FROM views WHERE trim(user_id) <> '' AND length(user_id) <= 100"))
def valid_views(x: Inputs) -> DataFrame:
    return views.valid_views(x.views())


@query(
    over(
        "faulty_views",
        """SELECT * FROM faulty_views WHERE trim(user_id, ' ' || chr(9)) <> '' AND length(user_id) <= 100
           AND trim(device_id, ' ' || chr(9)) <> '' AND length(device_id) <= 100""",
    )
)
def valid_views_faulty(x: Inputs) -> DataFrame:
    """Blank, over-long and missing ids of users and devices among the views."""
    return views.valid_views(x.faulty_views())


@query(over("views active", "SELECT v.*, d.name FROM views v JOIN active d ON v.device_id = d.device_id"))
def active_views(x: Inputs) -> DataFrame:
    return views.active_views(x.views(), x.devices())


@query(over("views active", f"SELECT * FROM views WHERE {_OWNED}"))
def trackable_views(x: Inputs) -> DataFrame:
    return views.trackable_views(x.views(), x.devices())


@query(over("views active", f"SELECT * FROM views WHERE NOT {_OWNED}"))
def rejected_views(x: Inputs) -> DataFrame:
    return views.rejected_views(x.views(), x.devices())


@query(
    over(
        "views active",
        f"""SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY views DESC, device_id) AS rank,
                   device_id, name, views
            FROM (SELECT v.user_id, v.device_id, d.name, count(*) AS views
                  FROM views v JOIN active d ON v.device_id = d.device_id
                  WHERE v.viewed_at >= TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY GROUP BY 1, 2, 3) c
            QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY views DESC, device_id) <= 5""",
    )
)
def top_devices(x: Inputs) -> DataFrame:
    return views.top_devices(x.views(), x.devices(), AS_OF)


_SINCE = "2024-01-30 00:00:00"


@query(
    over(
        "views",
        f"""SELECT user_id, device_id, count(*) FILTER (WHERE viewed_at >= TIMESTAMP '{_SINCE}') > 0 AS recent
            FROM views GROUP BY 1, 2""",
    )
)
def recent_views(x: Inputs) -> DataFrame:
    return views.recent_views(x.views(), _SINCE)


def _throttle_sql(gap: str, names: str = "views", source: str = "views", columns: str = "id, user_id, device_id, viewed_at") -> str:
    return over(
        names,
        f"SELECT {columns} FROM chain WHERE accepted",
        f"""ordered AS (SELECT *, row_number() OVER (PARTITION BY user_id, device_id ORDER BY viewed_at, id) AS n
                        FROM {source}),
            chain AS (SELECT *, true AS accepted, viewed_at AS kept FROM ordered WHERE n = 1
                      UNION ALL
                      SELECT o.*, o.viewed_at > c.kept + INTERVAL '{gap}',
                             CASE WHEN o.viewed_at > c.kept + INTERVAL '{gap}' THEN o.viewed_at ELSE c.kept END
                      FROM chain c JOIN ordered o ON o.user_id = c.user_id AND o.device_id = c.device_id
                                                 AND o.n = c.n + 1)""",
    )


query(_throttle_sql("1 minute"), "throttle_views")(lambda x: views.throttle_views(x.views()))
query(_throttle_sql("1 minute", "dense_views", "dense_views"), "throttle_views_dense")(
    lambda x: views.throttle_views(x.dense_views())
)
query(_throttle_sql("1 day"), "throttle_views_1d")(lambda x: views.throttle_views(x.views(), "1 day"))
query(_throttle_sql("6 hours"), "throttle_views_6h")(lambda x: views.throttle_views(x.views(), "6 hours"))


_TRACKED = f"(SELECT * FROM views WHERE {_OWNED}) own"


@query(_throttle_sql("1 day", "views active", _TRACKED))
def track_views(x: Inputs) -> DataFrame:
    """A view log as recorded: valid, of an own active device, and not repeated within a day."""
    own = views.trackable_views(views.valid_views(x.views()), x.devices())
    return views.throttle_views(own, "1 day")


@query(over("views", f"SELECT * FROM views WHERE viewed_at >= TIMESTAMP '{AS_OF}' - INTERVAL 10 DAY"))
def retain_views(x: Inputs) -> DataFrame:
    return views.retain_views(x.views(), AS_OF, 10)


@query(
    over(
        "views active expired gone_users",
        f"""SELECT 'deactivate_users' AS operation, count(*) AS affected FROM active
              WHERE user_id IN (SELECT user_id FROM gone_users)
            UNION ALL SELECT 'retain_views', count(*) FROM views
              WHERE viewed_at < TIMESTAMP '{AS_OF}' - INTERVAL 10 DAY
            UNION ALL SELECT 'retain_devices', count(*) FROM expired
            UNION ALL SELECT 'trackable_views', count(*) FROM views WHERE {_OWNED}""",
    )
)
def change_counts(x: Inputs) -> DataFrame:
    table, log = x.devices(), x.views()
    gone = devices.deleted_users(x.identity_events())
    return tables.change_counts(
        {
            "deactivate_users": devices.active_devices(table, gone, ["user_id"]),
            "retain_views": views.outdated_views(log, AS_OF, 10),
            "retain_devices": devices.expired_devices(table, AS_OF),
            "trackable_views": views.trackable_views(log, table),
        }
    )


# --- access and claims ----------------------------------------------------


@query(over("decisions", "SELECT * FROM decisions"))
def evaluate_access(x: Inputs) -> DataFrame:
    return access.evaluate_access(x.access_requests(), x.devices(), BRIDGE)


@query(over("decisions", "SELECT rule, allowed, count(*) AS requests FROM decisions GROUP BY 1, 2"))
def access_report(x: Inputs) -> DataFrame:
    return access.access_report(evaluate_access(x))


@query(over("decisions", "SELECT * FROM decisions WHERE rule = 'foreign_write'"))
def security_alerts(x: Inputs) -> DataFrame:
    return access.security_alerts(evaluate_access(x))


@query(over("claims", "SELECT * FROM claims WHERE regexp_full_match(code, '[0-9]{3}-[0-9]{3}')"))
def valid_claims(x: Inputs) -> DataFrame:
    return claims.valid_claims(x.claims())


@query(over("resolved", "SELECT * FROM resolved"))
def resolve_claims(x: Inputs) -> DataFrame:
    return claims.resolve_claims(x.codes(), claims.valid_claims(x.claims()), CLAIM_LIFE)


# --- sources, sinks and streams -------------------------------------------


def stream_of(x: Inputs) -> Inputs:
    """The same inputs over a stream of the events table."""
    schema = x.table("events").schema
    events = read_events(x.spark, "parquet", {"path": f"{x.folder}/[e]vents.parquet"}, schema)
    return Inputs(x.spark, x.folder, events)


@query(over("devices", "SELECT * FROM devices"))
def load_table(x: Inputs) -> DataFrame:
    """The registry written as a parquet table and loaded with its declared types."""
    from ..sources.tables import load_table as load

    path = shared_dir(x.spark, "devices")
    write_events(instants(x.devices(), "deactivated_at"), "parquet", {"path": path})
    return plain(load(x.spark, "devices", {"format": "parquet", "path": path}))


@query(over("views", "SELECT * FROM views"))
def load_view_history(x: Inputs) -> DataFrame:
    """The view history written as a parquet table and loaded with its declared types."""
    from ..sources.tables import load_table as load

    path = shared_dir(x.spark, "views")
    write_events(x.views(), "parquet", {"path": path})
    return load(x.spark, "device_view_history", {"format": "parquet", "path": path})


@query(over("points", "SELECT * FROM points"))
def load_points(x: Inputs) -> DataFrame:
    """Points written to their table and loaded with their declared types."""
    from ..sources.tables import load_table as load

    path = shared_dir(x.spark, "loaded-points")
    upsert_points(instants(x.points(), "ts"), path)
    return plain(load(x.spark, "telemetry_points", {"format": "parquet", "path": path}).filter("device_id IS NOT NULL").drop("arrival_ts", "partition"))


@query(over("parsed", f"SELECT device_id AS key, {_ENCODED} AS value FROM parsed WHERE valid"), "write_events")
def write_events_table(x: Inputs) -> DataFrame:
    """Keyed records through the file sink, the batch written twice."""
    path = shared_dir(x.spark, "records")
    records = ingest.keyed_records(ingest.valid_telemetry(ingest.parse_telemetry(x.raw())))
    for _ in range(2):
        write_events(records.select("key", "value"), "parquet", {"path": path}, batch_id=0, run="direct")
    return x.spark.read.parquet(path).select("key", "value")


@query(over("raw", "SELECT event_id, value FROM raw"), "read_events")
def read_events_stream(x: Inputs) -> DataFrame:
    """Raw records through the streaming source."""
    return S.drain(x.spark, stream_of(x).raw().select("event_id", "value"), "raw")


_STORED = """SELECT device_id, ts,
    arg_max(current_temperature, arrival) AS current_temperature,
    arg_max(target_temperature, arrival) FILTER (WHERE target_temperature IS NOT NULL) AS target_temperature,
    arg_max(heating_status, arrival) AS heating_status, max(arrival) AS arrival"""


def _ingest(x: Inputs) -> str:
    folder = shared_dir(x.spark, "ingest")
    source = stream_of(x).raw().select("value", "arrival")
    S.run_ingest(
        source,
        f"{folder}/points",
        ("parquet", {"path": f"{folder}/processed"}),
        ("parquet", {"path": f"{folder}/dlq"}),
        f"{folder}/checkpoint",
        {"availableNow": True},
        metrics_path=f"{folder}/metrics",
    ).awaitTermination()
    return folder


@query(over("parsed", f"{_STORED} FROM ({_TO_POINT}) w GROUP BY device_id, ts"))
def run_ingest(x: Inputs) -> DataFrame:
    """The streaming ingest job, read back from its points table."""
    return plain(read_points(x.spark, f"{_ingest(x)}/points").drop("arrival_ts", "partition", "date"))


@query(over("parsed", "SELECT count(*) FILTER (valid) AS telemetry_valid, count(*) FILTER (NOT valid) AS telemetry_invalid FROM parsed"))
def run_ingest_counts(x: Inputs) -> DataFrame:
    """Valid and invalid records as the ingest job counts them, from the rows it keeps by batch."""
    kept = x.spark.read.parquet(f"{_ingest(x)}/metrics")
    return kept.agg(F.sum("telemetry_valid").alias("telemetry_valid"), F.sum("telemetry_invalid").alias("telemetry_invalid"))


@query(over("parsed", f"SELECT device_id AS key, {_ENCODED} AS value FROM parsed WHERE valid"))
def run_ingest_processed(x: Inputs) -> DataFrame:
    return x.spark.read.parquet(f"{_ingest(x)}/processed").select("key", "value")


@query(over("parsed", "SELECT value FROM parsed WHERE NOT valid"))
def run_ingest_dead_letters(x: Inputs) -> DataFrame:
    return x.spark.read.parquet(f"{_ingest(x)}/dlq").select("value")


@query(over("writes", f"{_STORED} FROM writes GROUP BY device_id, ts"), "upsert_points")
def upsert_points_table(x: Inputs) -> DataFrame:
    """Two overlapping batches, the second written twice; each point is stored once."""
    path, writes = shared_dir(x.spark, "points"), instants(x.writes(), "ts")
    upsert_points(writes.filter("heating_status = 0"), path)
    for _ in range(2):
        upsert_points(writes, path)
    return plain(read_points(x.spark, path).drop("arrival_ts", "partition", "date"))


@query(over("points latest_purges", f"{_STORED} FROM ({_PURGED}) w GROUP BY device_id, ts"))
def run_purge(x: Inputs) -> DataFrame:
    """The streaming purge job, which takes purged readings out of the points table."""
    folder = shared_dir(x.spark, "purge")
    upsert_points(instants(x.points(), "ts"), f"{folder}/points")
    source = instants(x.purges(), "purge_ts").withColumnRenamed("purge_ts", "arrival_ts")
    write_events(source, "parquet", {"path": f"{folder}/events"})
    stream = read_events(x.spark, "parquet", {"path": f"{folder}/events"}, source.schema)
    S.run_purge(
        stream,
        f"{folder}/purges",
        f"{folder}/quarantine",
        f"{folder}/checkpoint",
        {"availableNow": True},
        f"{folder}/points",
    ).awaitTermination()
    return plain(read_points(x.spark, f"{folder}/points").drop("arrival_ts", "partition", "date"))


@query(over("points latest_purges", f"{_STORED} FROM ({_PURGED}) w GROUP BY device_id, ts"))
def compacted_after_purge(x: Inputs) -> DataFrame:
    """Points of two batches merged into days, then purged by writing the days of purged readings again."""
    folder = shared_dir(x.spark, "purged")
    purges = ingest.device_id_guard(ingest.parse_purges(instants(x.purges(), "purge_ts")))
    for odd in (0, 1):
        upsert_points(instants(x.points(), "ts").filter(f"arrival % 2 = {odd}"), folder)
    purge_stored(x.spark, folder, purges.filter("device_id_ok").select("device_id", "purge_ts"))
    return plain(read_points(x.spark, folder).drop("arrival_ts", "partition", "date"))


def _log(x: Inputs, name: str) -> tuple[str, str]:
    folder = shared_dir(x.spark, name)
    return f"{folder}/log", f"{folder}/checkpoint"


@query(_throttle_sql("1 day"))
def stream_throttle(x: Inputs) -> DataFrame:
    log, checkpoint = _log(x, "throttle")
    views_ = stream_of(x).views()
    S.stream_views(views_, log, checkpoint, gap="1 day", trigger=S.AVAILABLE_NOW).awaitTermination()
    return S.view_history(x.spark, log, views_.schema)


@query(_throttle_sql("1 day", "views active", _TRACKED))
def stream_track_views(x: Inputs) -> DataFrame:
    """Views of own devices chosen on the stream, and the history that they leave."""
    log, checkpoint = _log(x, "track")
    views_ = stream_of(x).views()
    own = S.stream_trackable_views(views_, x.devices()).select(*views_.columns)
    S.stream_views(own, log, checkpoint, gap="1 day", trigger=S.AVAILABLE_NOW).awaitTermination()
    return S.view_history(x.spark, log, views_.schema)


@query(_throttle_sql("1 day", "views active", _TRACKED))
def run_view_tracking(x: Inputs) -> DataFrame:
    """The view-tracking job, and the view history that it keeps as a table."""
    log, checkpoint = _log(x, "tracking")
    views_ = stream_of(x).views()
    S.run_view_tracking(views_, x.devices(), log, checkpoint, "1 day", S.AVAILABLE_NOW).awaitTermination()
    return S.view_history(x.spark, log, views_.schema)


@query(over("resolved", "SELECT * FROM resolved"))
def stream_claims(x: Inputs) -> DataFrame:
    log, checkpoint = _log(x, "claims")
    asked = claims.valid_claims(stream_of(x).claims())
    S.stream_claims(stream_of(x).codes(), asked, log, checkpoint, CLAIM_LIFE, S.AVAILABLE_NOW).awaitTermination()
    return S.claim_answers(x.spark, log, asked.schema["claimed_at"].dataType)


@query(
    over(
        "points",
        f"""SELECT * FROM ({_intervals_sql("3 hours")}) i
            WHERE stale_from <= (SELECT date_trunc('millisecond', max(ts)) FROM points)""",
    )
)
def stream_staleness(x: Inputs) -> DataFrame:
    log, checkpoint = _log(x, "staleness")
    points = instants(stream_of(x).points(), "ts")
    S.stream_staleness(points, log, checkpoint, "3 hours", "1 day", S.AVAILABLE_NOW).awaitTermination()
    return plain(S.online(x.spark, log, "3 hours", "1 day", closed=True))


@query(
    over(
        "points",
        f"""SELECT * FROM ({_history_sql("15 minutes")}) h WHERE "timestamp" <=
            (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 10 MINUTE FROM points)""",
    )
)
def stream_history(x: Inputs) -> DataFrame:
    log, checkpoint = _log(x, "history")
    points = instants(stream_of(x).points(), "ts")
    S.stream_history(points, "15 minutes", log, checkpoint, S.AVAILABLE_NOW).awaitTermination()
    return plain(S.history(x.spark, log, "10 minutes"))


@query(over("replayed_points", _LATE))
def stream_late_arrivals(x: Inputs) -> DataFrame:
    log, checkpoint = _log(x, "late")
    points = stream_of(x).replayed_points()
    S.stream_late_arrivals(points, log, checkpoint, S.AVAILABLE_NOW).awaitTermination()
    return S.lateness(x.spark, log, points.schema, "10 minutes")


@query(
    over(
        "points",
        f"""SELECT * FROM ({_intervals_sql("3 hours")}) i
            WHERE stale_from <= (SELECT date_trunc('millisecond', max(ts)) FROM points)""",
    )
)
def stream_stale_alarms(x: Inputs) -> DataFrame:
    """Devices that have gone silent, said by event-time timers when it happens."""
    return plain(S.drain(x.spark, S.stale_alarms(instants(stream_of(x).points(), "ts"), "3 hours"), "alarms"))


@query(over("replayed_points", _LATE))
def stream_judged(x: Inputs) -> DataFrame:
    """Readings on time and late ones, told apart on the stream, from both of their tables."""
    folder, checkpoint = _log(x, "judged")
    points = instants(stream_of(x).replayed_points(), "ts", "arrival_ts")
    S.stream_judged(points, folder, checkpoint, "10 minutes", S.AVAILABLE_NOW).awaitTermination()
    tables_ = [x.spark.read.parquet(f"{folder}/{name}").drop("run", "batch") for name in ("on_time", "late")]
    return plain(tables_[0].unionByName(tables_[1]))


@query(over("replayed_points", f"SELECT count(*) FILTER (NOT late) AS on_time, count(*) FILTER (late) AS late FROM ({_LATE}) l"))
def stream_judged_counts(x: Inputs) -> DataFrame:
    """How many readings were on time and late, by the stream's own count of each batch."""
    folder, checkpoint = _log(x, "counted")
    points = instants(stream_of(x).replayed_points(), "ts", "arrival_ts")
    S.stream_judged(points, folder, checkpoint, "10 minutes", S.AVAILABLE_NOW).awaitTermination()
    return x.spark.read.parquet(f"{folder}/counts").agg(F.sum("on_time").alias("on_time"), F.sum("late").alias("late"))


@query(
    over(
        "points",
        f"""SELECT * FROM ({_history_sql("15 minutes")}) h WHERE "timestamp" <=
            (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 10 MINUTE FROM points)""",
    )
)
def stream_closed_means(x: Inputs) -> DataFrame:
    """Bucket means that a stream gives out once the watermark has passed the bucket."""
    means = S.closed_means(instants(stream_of(x).points(), "ts"), "15 minutes", "10 minutes")
    return plain(S.drain(x.spark, means, "means"))


_AS_OF_SQL = over(
    "points devices",
    """SELECT p.*, v.name, v.target_temperature AS stored_target
       FROM points p ASOF LEFT JOIN versions v ON p.device_id = v.device_id AND p.ts >= v.valid_from""",
    f"""versions AS (
        SELECT device_id, valid_from, arg_max(name, seq) AS name, arg_max(target_temperature, seq) AS target_temperature
        FROM (SELECT device_id, TIMESTAMP '2024-01-03 00:00:00' AS valid_from, -1 AS seq, name,
                     coalesce(target_temperature, 0) AS target_temperature FROM devices
              UNION ALL SELECT {_device('user_id')}, ts, event_id, 'Room ' || event_id, CAST(15 + event_id % 10 AS DOUBLE)
              FROM events WHERE event_type = 'click') w
        GROUP BY 1, 2)""",
)


@query(_AS_OF_SQL)
def enrich_as_of(x: Inputs) -> DataFrame:
    """Readings with the name and target of their device at that time."""
    return devices.enrich_as_of(x.points(), x.device_versions())


@query(_AS_OF_SQL)
def run_enrich(x: Inputs) -> DataFrame:
    """The same on a stream, against the stored versions of the registry."""
    folder, checkpoint = _log(x, "enriched")
    versions = f"{folder}/versions"
    x.device_versions().write.parquet(versions)
    S.run_enrich(stream_of(x).points(), versions, f"{folder}/out", checkpoint, S.AVAILABLE_NOW).awaitTermination()
    return x.spark.read.parquet(f"{folder}/out").drop("run", "batch")


def _changed_registry(x: Inputs, touched: DataFrame, change: Callable[[DataFrame], DataFrame]) -> DataFrame:
    path = shared_dir(x.spark, "registry")
    write_registry(instants(x.devices(), "deactivated_at"), path)
    change_registry(x.spark, path, touched, lambda old: instants(change(plain(old)), "deactivated_at"))
    return plain(read_registry(x.spark, path))


@query(CATALOG["soft_delete"].sql)
def registry_soft_delete(x: Inputs) -> DataFrame:
    """Soft deletion as a job: buckets of the stored registry that change are written again."""
    return _changed_registry(x, x.commands(), lambda old: devices.soft_delete(old, x.commands(), AS_OF))


@query(CATALOG["apply_commands"].sql)
def registry_commands(x: Inputs) -> DataFrame:
    return _changed_registry(x, x.commands(), lambda old: devices.apply_commands(old, x.commands()))


@query(CATALOG["retain_devices"].sql)
def registry_retention(x: Inputs) -> DataFrame:
    gone = devices.expired_devices(x.devices(), AS_OF)
    return _changed_registry(x, gone, lambda old: devices.retain_devices(old, AS_OF))


@query(CATALOG["provision"].sql)
def registry_provision(x: Inputs) -> DataFrame:
    return _changed_registry(x, _claimed(x), lambda old: devices.provision(old, _claimed(x)))


@query(over("points", _history_sql("15 minutes", f"TIMESTAMP '{AS_OF}' - INTERVAL '24 hours'", f"TIMESTAMP '{AS_OF}'")))
def history_from_store(x: Inputs) -> DataFrame:
    """The last day's history out of the points table; only its days are read."""
    path = shared_dir(x.spark, "stored")
    upsert_points(instants(x.points(), "ts"), path)
    return plain(series.telemetry_history(read_points(x.spark, path), "-24h", AS_OF))


# --- driver contract ------------------------------------------------------


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(entry: Query):
        return lambda spark, folder: entry.run(Inputs(spark, folder.rstrip("/")))

    return {name: bind(entry) for name, entry in CATALOG.items()}


def oracle_sql() -> dict[str, str]:
    return {name: entry.sql for name, entry in CATALOG.items() if entry.sql}
