"""Time-series operators over points (device_id, ts, current_temperature, ...).

One device may hold a large share of all points.  Aggregations combine on the
map side; operators that need order within a device first work on slices of a
device (salts, time slices, arrival slices), reduce each slice, and only bring
the reduced rows of a device together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import clock, device_id_ok, interval, round_cents

# History ranges, their bucket widths, and buffer and timeout sizes.
HISTORY_RANGES = {
    "-24h": ("24 hours", "15 minutes"),
    "-6h": ("6 hours", "5 minutes"),
    "-1h": ("1 hour", "1 minute"),
}
DEFAULT_RANGE = "-1h"
DETAIL_BUFFER, DASHBOARD_BUFFER = 300, 200
STALE_AFTER, INGEST_TIMEOUT = "10 seconds", "120 seconds"

POINT_COLUMNS = ["current_temperature", "target_temperature", "heating_status"]


#: Order of arrival: time, then partition and offset; what is missing comes first.
ARRIVAL = ["arrival_ts", "partition", "arrival"]


def merge_points(writes: DataFrame) -> DataFrame:
    """Upsert semantics: one point per (device, ts), last non-null write per field.

    The last write is that with the highest (arrival_ts, partition, arrival) of those
    columns that there are.  A write without any of them still counts, before all others.
    """
    order = [c for c in ARRIVAL if c in writes.columns]
    place = F.struct(*order) if len(order) > 1 else F.struct(F.col(order[0]))
    by_arrival = [F.max_by(c, F.when(F.col(c).isNotNull(), place)).alias(c) for c in POINT_COLUMNS]
    days = ["date"] if "date" in writes.columns else []
    return writes.groupBy("device_id", "ts", *days).agg(
        *by_arrival, *[F.max(c).alias(c) for c in reversed(order)]
    )


def _between(points: DataFrame, start: Column | None, stop: Column | None) -> DataFrame:
    """``[start, stop)`` on ``ts``, repeated on a ``date`` partition column if there is one."""
    dated = "date" in points.columns
    if start is not None:
        points = points.filter(F.col("ts") >= start)
        points = points.filter(F.col("date") >= F.to_date(start)) if dated else points
    if stop is not None:
        points = points.filter(F.col("ts") < stop)
        points = points.filter(F.col("date") <= F.to_date(stop)) if dated else points
    return points


def partial_means(points: DataFrame, width: str, stop: Column | None = None) -> DataFrame:
    """Exact sums of temperature per device and epoch-aligned bucket, stamped with its end (cut at ``stop``).

    Decimal sums do not depend on their order, so neither does a mean made of any
    number of parts.  A temperature that is not finite has no part in a mean.
    """
    sums = _sums(points, "device_id", F.window("ts", width).alias("bucket"))
    end = F.col("bucket.end")
    return sums.select(
        "device_id",
        (end if stop is None else F.least(end, stop)).alias("timestamp"),
        "total",
        "readings",
        "last",
    )


def _sums(points: DataFrame, *keys: str | Column) -> DataFrame:
    exact = F.col("current_temperature").try_cast("decimal(28,6)")
    return (
        points.withColumn("_exact", exact)
        .filter(F.col("_exact").isNotNull())
        .groupBy(*keys)
        .agg(
            F.sum("_exact").cast("decimal(38,6)").alias("total"),
            F.count(F.lit(1)).alias("readings"),
            F.max("ts").alias("last"),
        )
    )


def mean_of(parts: DataFrame) -> DataFrame:
    """Mean temperatures of buckets from all of their parts."""
    whole = parts.groupBy("device_id", "timestamp").agg(F.sum("total").alias("total"), F.sum("readings").alias("readings"))
    return whole.select("device_id", "timestamp", _cents("total", "readings"))


def _cents(total: str, readings: str) -> Column:
    """The mean of an exact sum, rounded to cents."""
    return round_cents(F.col(total).cast("double") / F.col(readings)).alias("temperature")


def bucket_means(
    points: DataFrame,
    width: str,
    start: Column | None = None,
    stop: Column | None = None,
) -> DataFrame:
    """Mean temperature per device and epoch-aligned bucket; empty buckets are omitted.

    A bucket is stamped with its end, cut at ``stop``.
    """
    parts = partial_means(_between(points, start, stop), width, stop)
    return parts.select("device_id", "timestamp", _cents("total", "readings"))


def telemetry_history(points: DataFrame, range_: str, as_of: str) -> DataFrame:
    """History of every device over ``[as_of - range, as_of)``; an unknown range means the last hour."""
    span, width = HISTORY_RANGES.get(range_, HISTORY_RANGES[DEFAULT_RANGE])
    now = clock(points, "ts", as_of)
    wanted = points.filter(device_id_ok(F.col("device_id")))
    return bucket_means(wanted, width, now - interval(span), now)


def telemetry_histories(points: DataFrame, asked: DataFrame, as_of: str) -> DataFrame:
    """``telemetry_history`` for each (device_id, range) of ``asked``, from one scan of the points.

    Points of devices that nobody asked for go before anything is summed; the points
    are on the left with nothing between shuffle and join, where AQE can split a busy device.
    """
    now = clock(points, "ts", as_of)
    widest = max(HISTORY_RANGES.values(), key=lambda r: int(r[0].split()[0]))[0]
    ranges = asked.groupBy("device_id").agg(F.collect_set("range").alias("ranges"))
    wanted = _between(points, now - interval(widest), now).filter(device_id_ok(F.col("device_id")))
    per_range = (
        wanted.select("device_id", "ts", "current_temperature")
        .join(ranges, "device_id")
        .select("device_id", "ts", "current_temperature", F.explode("ranges").alias("range"))
    )
    choose = lambda value: F.coalesce(
        *[F.when(F.col("range") == r, value(*of)) for r, of in HISTORY_RANGES.items()]
    )
    per_range = per_range.filter(F.col("ts") >= choose(lambda span, _: now - interval(span)))
    end = choose(lambda _, width: _bucket_end(points, width))
    sums = _sums(per_range, "device_id", "range", end.alias("end"))
    return sums.select(
        "device_id", F.least("end", now).alias("timestamp"), _cents("total", "readings"), "range"
    )


def _bucket_end(points: DataFrame, width: str) -> Column:
    """End of the bucket of ``ts``; buckets begin at 1970-01-01 UTC."""
    kind = points.schema["ts"].dataType.typeName()
    zero = F.lit("1970-01-01 00:00:00").cast(kind) if kind == "timestamp_ntz" else F.timestamp_micros(F.lit(0))
    size = F.timestamp_diff("MICROSECOND", zero, zero + interval(width))
    since = F.timestamp_diff("MICROSECOND", zero, F.col("ts"))
    return F.timestamp_add("MICROSECOND", since - F.pmod(since, size) + size, zero)


def history_ranges(requests: DataFrame, as_of: str) -> DataFrame:
    """Bounds and bucket width per request row with a ``range`` column."""
    now = F.lit(as_of).cast("timestamp_ntz")

    def choose(values: dict[str, Column]) -> Column:
        chosen = F.when(F.col("range") == "-24h", values["-24h"])
        chosen = chosen.when(F.col("range") == "-6h", values["-6h"])
        return chosen.otherwise(values[DEFAULT_RANGE])

    return requests.select(
        *requests.columns,
        choose({k: now - interval(span) for k, (span, _) in HISTORY_RANGES.items()}).alias("start"),
        now.alias("stop"),
        choose({k: F.lit(width) for k, (_, width) in HISTORY_RANGES.items()}).alias("bucket"),
    )


def latest_readings(points: DataFrame) -> DataFrame:
    """The last reading to arrive from each device."""
    columns = ["ts", *POINT_COLUMNS]
    # One max_by per fixed-width column keeps this a hash aggregate.
    return points.groupBy("device_id").agg(
        *[F.max_by(c, "arrival").alias(c) for c in columns], F.max("arrival").alias("arrival")
    )


def _last_by(rows: DataFrame, n: int, order: list[Column], salts: int) -> DataFrame:
    """The last ``n`` rows of each device in ``order`` (given descending).

    A salt spreads one device over many tasks: each salt keeps its own last
    ``n``, and at most ``n * salts`` rows of a device meet in the final ranking.
    """
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in rows.columns]), F.lit(salts))
    per_salt = W.partitionBy("device_id", "_salt").orderBy(*order)
    per_device = W.partitionBy("device_id").orderBy(*order)
    return (
        rows.withColumn("_salt", salt)
        .withColumn("_rank", F.row_number().over(per_salt))
        .filter(F.col("_rank") <= n)
        .drop("_rank", "_salt")
        .withColumn("_rank", F.row_number().over(per_device))
        .filter(F.col("_rank") <= n)
        .drop("_rank")
    )


def last_n(points: DataFrame, n: int = DETAIL_BUFFER, salts: int = 32) -> DataFrame:
    """The last ``n`` readings of each device in arrival order."""
    return _last_by(points, n, [F.desc("arrival")], salts)


def history_with_tail(
    history: DataFrame, points: DataFrame, n: int = DETAIL_BUFFER, salts: int = 32
) -> DataFrame:
    """History buckets followed by live readings in arrival order, cut to the last ``n``."""
    head = history.select(
        "device_id",
        "timestamp",
        "temperature",
        F.lit(0).alias("section"),
        F.lit(None).cast("bigint").alias("arrival"),
    )
    tail = points.select(
        "device_id",
        F.col("ts").alias("timestamp"),
        F.col("current_temperature").alias("temperature"),
        F.lit(1).alias("section"),
        "arrival",
    )
    order = [F.desc("section"), F.desc_nulls_last("arrival"), F.desc("timestamp")]
    return _last_by(head.unionByName(tail), n, order, salts)


def purge_points(
    points: DataFrame, purges: DataFrame, arrived_at: str | None = None, salts: int = 32
) -> DataFrame:
    """Drop the points that each purged device had up to its latest purge.

    ``purges`` has (device_id, purge_ts).  With ``arrived_at`` (null counts as
    the reading's own time), readings that arrived after the purge ran are kept
    even if their own time is earlier.

    Where the purges are too many to broadcast, a salt spreads the points of one
    device over ``salts`` tasks; each latest purge is repeated once per salt.
    """
    latest = (
        purges.groupBy("device_id")
        .agg(F.max("purge_ts").alias("purge_ts"))
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    )
    p = points.withColumn("_salt", F.pmod(F.xxhash64("ts"), F.lit(salts)).cast("int")).alias("p")
    d = latest.alias("d")
    gone = (
        (F.col("p.device_id") == F.col("d.device_id"))
        & (F.col("p._salt") == F.col("d._salt"))
        & (F.col("p.ts") <= F.col("d.purge_ts"))
    )
    if arrived_at:
        gone = gone & (F.coalesce(f"p.{arrived_at}", "p.ts") <= F.col("d.purge_ts"))
    return p.join(d, gone, "left_anti").drop("_salt")


def stale_devices(points: DataFrame, as_of: str, gap: str = STALE_AFTER) -> DataFrame:
    """Last reading time per device and whether it lies more than ``gap`` back."""
    now = clock(points, "ts", as_of)
    last = points.groupBy("device_id").agg(F.max("ts").alias("last_seen"))
    return last.withColumn("stale", now - F.col("last_seen") > interval(gap))


def ingest_health(points: DataFrame, as_of: str, timeout: str = INGEST_TIMEOUT) -> DataFrame:
    """Healthy when the last message is less than ``timeout`` old."""
    now = clock(points, "ts", as_of)
    last = points.agg(F.max("ts").alias("last_message"))
    healthy = F.coalesce(now - F.col("last_message") < interval(timeout), F.lit(False))
    return last.withColumn("healthy", healthy)


def _join_runs(spans: DataFrame, keys: list[str], gap: Column) -> DataFrame:
    """Join spans of equal ``keys`` that follow each other within ``gap``."""
    ordered = W.partitionBy(*keys).orderBy("online_from", "last_seen")
    before = F.max("last_seen").over(ordered.rowsBetween(W.unboundedPreceding, -1))
    starts = F.when(F.col("online_from") - before <= gap, 0).otherwise(1)
    return (
        spans.withColumn("_starts", starts)
        .withColumn("_run", F.sum("_starts").over(ordered.rowsBetween(W.unboundedPreceding, 0)))
        .groupBy(*keys, "_run")
        .agg(
            F.min("online_from").alias("online_from"),
            F.max("last_seen").alias("last_seen"),
            F.sum("readings").alias("readings"),
        )
        .drop("_run")
    )


def online_intervals(
    points: DataFrame, gap: str = STALE_AFTER, slice_: str = "10 minutes"
) -> DataFrame:
    """Spans in which a device was never silent for more than ``gap``.

    Spans are first built inside time slices of a device.  Only spans within
    ``gap`` of a slice border can continue next door, at most two per slice, so
    those alone are brought together per device; the others stay in their slice.
    """
    return join_spans(slice_spans(points, gap, slice_), gap, slice_, joined=True)


def slice_spans(points: DataFrame, gap: str = STALE_AFTER, slice_: str = "10 minutes") -> DataFrame:
    """Spans (device_id, online_from, last_seen, readings) within time slices, not joined across their borders."""
    # Device, slice and time are all that is shuffled.
    sliced = (
        points.select("device_id", F.window("ts", slice_).start.alias("_slice"), F.col("ts").alias("online_from"))
        .repartition("device_id", "_slice")
        .withColumns({"last_seen": F.col("online_from"), "readings": F.lit(1).cast("bigint")})
    )
    return _join_runs(sliced, ["device_id", "_slice"], interval(gap)).drop("_slice")


def merge_spans(spans: DataFrame, gap: str = STALE_AFTER, slice_: str = "10 minutes") -> DataFrame:
    """Spans of several parts of the readings that touch within a time slice, as one."""
    sliced = spans.withColumn("_slice", F.window("online_from", slice_).start)
    return _join_runs(sliced, ["device_id", "_slice"], interval(gap)).drop("_slice")


def join_spans(
    spans: DataFrame, gap: str = STALE_AFTER, slice_: str = "10 minutes", joined: bool = False
) -> DataFrame:
    """Spans of ``slice_spans``, of one or many parts of the readings, to online intervals.

    ``joined``: they are of one part, so within a slice they are final."""
    silence = interval(gap)
    sliced = spans.withColumn("_slice", F.window("online_from", slice_).start)
    local = sliced if joined else _join_runs(sliced, ["device_id", "_slice"], silence)
    slice_end = F.col("_slice") + interval(slice_)
    inner = (F.col("online_from") - F.col("_slice") > silence) & (slice_end - F.col("last_seen") > silence)
    zoned = local.withColumn("_zone", F.when(inner, F.col("_slice"))).drop("_slice")
    return _join_runs(zoned, ["device_id", "_zone"], silence).select(
        "device_id",
        "online_from",
        "last_seen",
        "readings",
        (F.col("last_seen") + silence).alias("stale_from"),
    )


def late_arrivals(
    points: DataFrame, delay: str = "0 seconds", slice_rows: int = 100_000
) -> DataFrame:
    """Event-time lag of every reading, and whether it was late.

    Late means more than ``delay`` behind the highest event time that the same
    device had sent before, in arrival order.  That running maximum is taken
    inside slices of the arrival order.  A slice starts with one leading row: the
    maximum of all earlier slices of its device.  ``points`` has (device_id, ts,
    arrival, arrival_ts).
    """
    sliced = points.withColumn("_slice", F.floor(F.col("arrival") / slice_rows))
    earlier = W.partitionBy("device_id").orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    lead = (
        sliced.groupBy("device_id", "_slice")
        .agg(F.max("ts").alias("_top"))
        .select("device_id", "_slice", F.max("_top").over(earlier).alias("ts"), F.lit(0).alias("_row"))
    )
    before = (
        W.partitionBy("device_id", "_slice")
        .orderBy("_row", "arrival")
        .rowsBetween(W.unboundedPreceding, -1)
    )
    lag = F.unix_micros(F.col("arrival_ts").cast("timestamp")) - F.unix_micros(
        F.col("ts").cast("timestamp")
    )
    return (
        sliced.withColumn("_row", F.lit(1))
        .unionByName(lead, allowMissingColumns=True)
        .withColumn("seen_until", F.max("ts").over(before))
        .filter(F.col("_row") == 1)
        .select(
            *points.columns,
            "seen_until",
            lag.alias("lag_micros"),
            F.coalesce(F.col("seen_until") - F.col("ts") > interval(delay), F.lit(False)).alias("late"),
        )
    )
