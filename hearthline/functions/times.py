from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# An instant on the wire, date and time with an offset (with or
# without a colon), or seconds since 1970.
_DATE_TIME = r"^[+-]?[0-9]{4,}-[0-9]{2}-[0-9]{2}[Tt][0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]{1,9})?"
_ISO = _DATE_TIME + r"([Zz]|[+-][0-9]{2}:[0-9]{2})\z"
_ISO_SHORT = _DATE_TIME + r"[+-][0-9]{4}\z"
_EPOCH = r"^-?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?\z"


def interval(text: str) -> Column:
    """``'30 days'`` as a day-time interval literal."""
    amount, unit = text.split()
    return F.expr(f"INTERVAL '{amount}' {unit.rstrip('s').upper()}")


def clock(df: DataFrame, column: str, as_of: str | datetime) -> Column:
    """``as_of`` as a literal of the column's own type, so comparisons stay
    cast-free and reach the parquet scan."""
    return F.lit(str(as_of)).cast(df.schema[column].dataType)


def truncate_millis(ts: Column) -> Column:
    return F.date_trunc("MILLISECOND", ts)


def parse_instant(text: Column) -> Column:
    """ISO-8601 with an offset, or epoch seconds; null when it is neither."""
    colon = F.regexp_replace(text, r"([0-9]{2})\z", ":$1")
    seconds = text.try_cast("decimal(26,6)")
    return (
        F.when(text.rlike(_ISO), F.upper(text).try_cast("timestamp"))
        .when(text.rlike(_ISO_SHORT), F.upper(colon).try_cast("timestamp"))
        .when(text.rlike(_EPOCH), F.timestamp_micros((seconds * 1_000_000).try_cast("bigint")))
        .otherwise(F.lit(None).cast("timestamp"))
    )


def iso_instant(ts: Column) -> Column:
    """UTC text with no, three or six fraction digits, whichever is exact."""
    micros = F.pmod(F.unix_micros(ts), F.lit(1_000_000))
    length = F.when(micros == 0, 19).when(micros % 1000 == 0, 23).otherwise(26)
    utc = F.to_utc_timestamp(ts, F.current_timezone())
    full = F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return F.concat(F.substring(full, F.lit(1), length), F.lit("Z"))
