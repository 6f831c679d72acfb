"""Streams whose answers do not depend on how the input is cut into batches, or on its order.

A stream appends to a log of folders what each micro-batch adds, or keeps what batches add, partial sums or
spans, merged by day.  The answer is a table that batches revise, or is read from the log by the batch operator, or by
merging the partials.  A late row is a row like any other: nothing is dropped, no
watermark is needed, and no state is kept between batches, so a device or code with
a third of all rows is handled by the slices of the batch operators.

Folders are ``run=<query>/batch=<n>/date=<day>``.  ``run`` is the id that a query keeps in its checkpoint, so
a batch that runs again replaces its own folder, and a query with a fresh checkpoint
never touches what another has written.  A read can be bounded by days.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..functions import interval
from ..operators.claims import CLAIM_TTL, resolve_claims
from ..operators.series import STALE_AFTER, join_spans, late_arrivals, mean_of, merge_spans, partial_means, slice_spans
from ..operators.views import VIEW_GAP, throttle_views, trackable_views, valid_views
from ..sources.days import days_of, read_days, replace_days, revise_days, within
from ..sources.events import read_folders, run_of, write_batch

_PLACE = [
    T.StructField("run", T.StringType()),
    T.StructField("batch", T.LongType()),
    T.StructField("date", T.DateType()),
]
Step = Callable[[DataFrame], DataFrame]


def append_log(
    stream: DataFrame, path: str, checkpoint: str, time: str, add: Step | None = None, trigger: dict | None = None
) -> StreamingQuery:
    """Append ``add(batch)`` to the log at ``path`` after each micro-batch, by days of its column ``time``."""

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = add(batch) if add else batch
        dated = rows.withColumn("date", F.to_date(time))
        write_batch(dated, "parquet", {"path": path}, batch_id, run_of(batch.sparkSession), by=["date"])

    return start(stream, write, checkpoint, trigger)


def merge_log(
    stream: DataFrame, path: str, checkpoint: str, time: str, add: Step, merge: Step, schema: T.StructType, trigger: dict | None = None
) -> StreamingQuery:
    """Keep ``merge`` of all ``add(batch)`` by days of the column ``time``: a table that grows with what it says and
    not with the number of batches.

    The rows of the last batch stay apart, with its query and number, so a batch that runs again replaces its own."""
    place = T.StructType(_PLACE[:2])

    def write(batch: DataFrame, batch_id: int) -> None:
        run = run_of(batch.sparkSession)
        rows = add(batch).select(*schema.fieldNames()).withColumn("date", F.to_date(time)).persist()
        try:
            days = days_of(rows)
            if not days:
                return
            stored = within(read_days(batch.sparkSession, path, T.StructType([*schema.fields, *place.fields]), "readings"), days)
            other = stored.filter((F.col("run") != run) | (F.col("batch") != batch_id)).drop("run", "batch")
            merged = merge(other).withColumns({"date": F.to_date(time), "run": F.lit(""), "batch": F.lit(-1).cast("long")})
            own = rows.withColumns({"run": F.lit(run), "batch": F.lit(batch_id).cast("long")})
            replace_days(merged.select(*own.columns).unionByName(own), days, path, "device_id", time)
        finally:
            rows.unpersist()

    return start(stream, write, checkpoint, trigger)


def read_log(spark: SparkSession, path: str, schema: T.StructType, days: Column | None = None) -> DataFrame:
    """All rows of the log, or those of the days for which ``days``, a condition on ``date``, holds."""
    rows = read_folders(spark, path, T.StructType([*schema.fields, *_PLACE]))
    return (rows if days is None else rows.filter(days)).select(*schema.fieldNames())


def start(stream: DataFrame, write, checkpoint: str, trigger: dict | None) -> StreamingQuery:
    return (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "60 seconds"}))
        .start()
    )


# Views ------------------------------------------------------------------------


def stream_views(
    views: DataFrame,
    path: str,
    checkpoint: str,
    devices: DataFrame | None = None,
    gap: str = VIEW_GAP,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Views to a log, and after each micro-batch the view history as a table; with ``devices`` only valid
    views of own active devices.

    A batch changes the history of a (user, device) from its first new view on.  The view kept before that
    and the logged views after it are throttled again, and days whose history came out
    otherwise are written; a view in order costs its own day, a late one the days that it changes.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = trackable_views(valid_views(batch), devices).select(*views.columns) if devices is not None else batch
        rows = rows.withColumn("date", F.to_date("viewed_at")).persist()
        try:
            write_batch(rows, "parquet", {"path": f"{path}/log"}, batch_id, run_of(spark), by=["date"])
            revise_history(spark, path, rows, views.schema, gap)
        finally:
            rows.unpersist()

    return start(views.filter(F.col("viewed_at").isNotNull()), write, checkpoint, trigger)


def revise_history(spark: SparkSession, path: str, rows: DataFrame, schema: T.StructType, gap: str = VIEW_GAP) -> None:
    """Bring the history up to date with logged ``rows``, which may be logged again after a failure."""
    first = rows.agg(F.min("viewed_at").alias("at")).first()["at"]
    if first is None:
        return
    history = read_days(spark, f"{path}/history", schema, "viewed_at")
    near = history.filter(F.col("date") >= F.to_date(F.lit(first) - interval(gap)))
    log = read_log(spark, f"{path}/log", schema).filter(F.col("viewed_at") >= F.lit(first))
    touched = rows.groupBy(F.col("user_id").alias("of_user"), F.col("device_id").alias("of_device")).agg(
        F.min("viewed_at").alias("since")
    )
    same = F.col("user_id").eqNullSafe(F.col("of_user")) & F.col("device_id").eqNullSafe(F.col("of_device"))

    def of_touched(views: DataFrame, when: Column) -> DataFrame:
        return views.join(touched, same & when).drop("of_user", "of_device", "since")

    at, since = F.col("viewed_at"), F.col("since")
    before = of_touched(near, (at < since) & (at >= since - interval(gap)))
    after = of_touched(log, at >= since)
    chain = before.drop("date").withColumn("kept_before", F.lit(True)).unionByName(after.withColumn("kept_before", F.lit(False)))
    new = throttle_views(chain, gap).filter("NOT kept_before").withColumn("date", F.to_date("viewed_at"))
    revise_days(history, of_touched(near, at >= since), new, f"{path}/history", "user_id", "device_id", "viewed_at")


def view_history(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The view history as the batches so far have left it: none within the gap of the one kept before it."""
    return read_days(spark, f"{path}/history", schema, "viewed_at").select(*schema.fieldNames())


# Claims -----------------------------------------------------------------------


def stream_claims(
    codes: DataFrame, claims: DataFrame, path: str, checkpoint: str, ttl: str = CLAIM_TTL, trigger: dict | None = None
) -> StreamingQuery:
    """Codes issued and claims made to a log, and after each micro-batch the answers as a table.

    An event can change what claims get in its own slice of ``ttl`` and in the next one.  These are resolved again,
    and days with another answer are written: an answer that a late event has overtaken is taken back.
    """
    issued = codes.select(
        "code", F.lit(False).alias("is_claim"), F.col("issue_id").alias("id"), "user_id", F.col("issued_at").alias("at")
    )
    asked = claims.select(
        "code", F.lit(True).alias("is_claim"), F.col("claim_id").alias("id"),
        F.lit(None).cast("string").alias("user_id"), F.col("claimed_at").alias("at"),
    )
    both = issued.unionByName(asked).filter(F.col("at").isNotNull())
    schema = both.schema

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = batch.withColumn("date", F.to_date("at")).persist()
        try:
            write_batch(rows, "parquet", {"path": f"{path}/log"}, batch_id, run_of(batch.sparkSession), by=["date"])
            revise_claims(batch.sparkSession, path, rows, schema, ttl)
        finally:
            rows.unpersist()

    return start(both, write, checkpoint, trigger)


def _answers(schema: T.StructType) -> T.StructType:
    at = schema["at"].dataType
    return (
        T.StructType().add("claim_id", "long").add("code", "string").add("claimed_at", at)
        .add("issue_id", "long").add("user_id", "string").add("status", "string")
    )


def revise_claims(spark: SparkSession, path: str, rows: DataFrame, schema: T.StructType, ttl: str = CLAIM_TTL) -> None:
    """Bring the answers up to date with logged ``rows``, which may be logged again after a failure."""
    ends = rows.agg(F.min("at").alias("first"), F.max("at").alias("last")).first()
    if ends["first"] is None:
        return
    life = interval(ttl)
    low, high = F.lit(ends["first"]) - life - life, F.lit(ends["last"]) + life + life
    near = (F.col("date") >= F.to_date(low)) & (F.col("date") <= F.to_date(high))
    stored = read_days(spark, f"{path}/answers", _answers(schema), "claimed_at")
    own = rows.select(F.col("code").alias("of_code"), F.window("at", ttl).start.alias("of_slice"))
    hit = own.unionByName(own.withColumn("of_slice", F.col("of_slice") + life)).distinct()
    read = hit.unionByName(hit.withColumn("of_slice", F.col("of_slice") - life)).distinct()

    def within_slices(events: DataFrame, time: str, slices: DataFrame) -> DataFrame:
        sliced = events.withColumn("_slice", F.window(time, ttl).start)
        same = F.col("code").eqNullSafe(F.col("of_code")) & (F.col("_slice") == F.col("of_slice"))
        return sliced.join(slices, same, "left_semi").drop("_slice")

    log = within_slices(read_log(spark, f"{path}/log", schema, near), "at", read)
    new = within_slices(resolve_log(log, ttl), "claimed_at", hit).withColumn("date", F.to_date("claimed_at"))
    old = within_slices(stored.filter(near), "claimed_at", hit)
    revise_days(stored, old, new, f"{path}/answers", "code", "claimed_at")


def resolve_log(log: DataFrame, ttl: str = CLAIM_TTL) -> DataFrame:
    codes = log.filter("NOT is_claim").select(F.col("id").alias("issue_id"), "code", "user_id", F.col("at").alias("issued_at"))
    claims = log.filter("is_claim").select(F.col("id").alias("claim_id"), "code", F.col("at").alias("claimed_at"))
    return resolve_claims(codes, claims, ttl)


def claim_answers(spark: SparkSession, path: str, at: T.DataType) -> DataFrame:
    """The answer to each claim as the batches so far have left it."""
    schema = _answers(T.StructType().add("at", at))
    return read_days(spark, f"{path}/answers", schema, "claimed_at").select(*schema.fieldNames())


# Readings ---------------------------------------------------------------------


_SUMS = (
    T.StructType().add("device_id", "string").add("timestamp", "timestamp").add("total", "decimal(38,6)")
    .add("readings", "long").add("last", "timestamp")
)
_SPANS = T.StructType().add("device_id", "string").add("online_from", "timestamp").add("last_seen", "timestamp").add("readings", "long")


def stream_history(points: DataFrame, bucket: str, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Sums and counts of each bucket that a batch touches to the table of all of them."""

    def merge(parts: DataFrame) -> DataFrame:
        return parts.groupBy("device_id", "timestamp").agg(
            F.sum("total").cast("decimal(38,6)").alias("total"), F.sum("readings").alias("readings"), F.max("last").alias("last")
        )

    return merge_log(points, path, checkpoint, "timestamp", lambda batch: partial_means(batch, bucket), merge, _SUMS, trigger)


def history(spark: SparkSession, path: str, delay: str | None = None) -> DataFrame:
    """Bucket means of all readings; with ``delay`` only of buckets that ended that long before the last one."""
    parts = read_days(spark, path, _SUMS, "readings")
    means = mean_of(parts)
    if delay is not None:
        last = parts.agg((F.date_trunc("MILLISECOND", F.max("last")) - interval(delay)).alias("at")).first()["at"]
        means = means.filter(F.col("timestamp") <= F.lit(last))
    return means


def stream_staleness(
    points: DataFrame, path: str, checkpoint: str, gap: str = STALE_AFTER, slice_: str = "10 minutes", trigger: dict | None = None
) -> StreamingQuery:
    """The spans of each batch within time slices to the table of all of them; read it with the same ``gap`` and ``slice_``."""
    return merge_log(
        points, path, checkpoint, "online_from", lambda batch: slice_spans(batch, gap, slice_),
        lambda spans: merge_spans(spans, gap, slice_), _SPANS, trigger,
    )


def online(spark: SparkSession, path: str, gap: str = STALE_AFTER, slice_: str = "10 minutes", closed: bool = False) -> DataFrame:
    """Online spans of all readings; ``closed``: only those that the last reading of all is ``gap`` past."""
    parts = read_days(spark, path, _SPANS, "readings").select(*_SPANS.fieldNames())
    spans = join_spans(parts, gap, slice_)
    if closed:
        last = parts.agg(F.date_trunc("MILLISECOND", F.max("last_seen")).alias("at")).first()["at"]
        spans = spans.filter(F.col("stale_from") <= F.lit(last))
    return spans


def stream_late_arrivals(points: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Readings in any order to the log; ``arrival`` gives the order they are judged in."""
    return append_log(points, path, checkpoint, "arrival_ts", None, trigger)


def lateness(spark: SparkSession, path: str, schema: T.StructType, delay: str = "0 seconds") -> DataFrame:
    return late_arrivals(read_log(spark, path, schema), delay)
