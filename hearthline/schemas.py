"""Declared schemas.  Nothing is inferred from data."""

from pyspark.sql import types as T


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, dtype) for name, dtype in fields])


_S, _D, _B, _L, _TS, _NTZ = (
    T.StringType(),
    T.DoubleType(),
    T.BooleanType(),
    T.LongType(),
    T.TimestampType(),
    T.TimestampNTZType(),
)

# Wire format of one reading.  Leaves are read as text and cast afterwards, so
# that a quoted number is accepted and a wrong type is told apart from null.
TELEMETRY_JSON = _struct(
    ("deviceId", _S),
    ("timestamp", _S),
    (
        "data",
        _struct(("currentTemperature", _S), ("targetTemperature", _S), ("heatingStatus", _S)),
    ),
)

PURGE_JSON = _struct(("deviceId", _S), ("action", _S))

RAW = _struct(("value", _S), ("arrival", _L), ("arrival_ts", _TS))

POINTS = _struct(
    ("device_id", _S),
    ("ts", _TS),
    ("current_temperature", _D),
    ("target_temperature", _D),
    ("heating_status", T.IntegerType()),
    ("partition", T.IntegerType()),
    ("arrival", _L),
    ("arrival_ts", _TS),
)

DEVICES = _struct(
    ("id", _L),
    ("device_id", _S),
    ("hashed_device_token", _S),
    ("user_id", _S),
    ("name", _S),
    ("location", _S),
    ("is_active", _B),
    ("deactivated_at", _TS),
    ("target_temperature", _D),
)

DEVICE_VIEWS = _struct(("id", _L), ("user_id", _S), ("device_id", _S), ("viewed_at", _NTZ))

TABLES = {"devices": DEVICES, "device_view_history": DEVICE_VIEWS, "telemetry_points": POINTS}
