"""Checkpointed jobs.  A micro-batch writes records under the id of its query and its own number, and merges
points into the days it touches, so a batch that is run again after a failure changes nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators.devices import enrich_as_of
from ..operators.ingest import (
    dead_letters,
    device_id_guard,
    keyed_records,
    parse_purges,
    parse_telemetry,
    to_points,
    valid_telemetry,
    validity_counts,
)
from ..operators.views import VIEW_GAP, trackable_views, valid_views
from ..session import shared_dir
from ..sources.events import read_folders, run_of, write_batch, write_events
from ..sources.points import purge_stored, upsert_points
from .logs import start, stream_views

Sink = tuple[str, dict[str, str]]
AVAILABLE_NOW = {"availableNow": True}
_PURGES = T.StructType().add("device_id", "string").add("purge_ts", "timestamp")


def run_ingest(
    source: DataFrame,
    points_path: str,
    processed: Sink,
    dlq: Sink,
    checkpoint: str,
    trigger: dict | None = None,
    purges_path: str | None = None,
    metrics_path: str | None = None,
) -> StreamingQuery:
    """Raw JSON readings to the points table, keyed processed records and dead letters.

    ``source`` has (value, arrival) and may have arrival_ts.  There is no
    watermark: late readings are stored like any others.  With the log of ``run_purge`` at ``purges_path``, readings
    that had arrived before a purge of their device are not stored.  With ``metrics_path``, the numbers of valid
    and invalid records of each batch are kept there, counted while the batch is written.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        # One decode serves all three sinks.
        parsed = batch.persist()
        try:
            events = valid_telemetry(parsed)
            run = run_of(batch.sparkSession)
            purges = read_folders(batch.sparkSession, purges_path, _PURGES) if purges_path else None
            upsert_points(to_points(events), points_path, purges)
            write_events(keyed_records(events), *processed, batch_id, run)
            write_events(dead_letters(parsed), *dlq, batch_id, run)
            if metrics_path:
                write_batch(validity_counts(parsed), "parquet", {"path": metrics_path}, batch_id, run)
        finally:
            parsed.unpersist()

    counted = parse_telemetry(source).observe(
        "telemetry",
        F.count_if("valid").alias("telemetry_valid"),
        F.count_if(~F.col("valid")).alias("telemetry_invalid"),
    )
    return start(counted, write, checkpoint, trigger)


def run_purge(
    source: DataFrame,
    purges_path: str,
    quarantine_path: str,
    checkpoint: str,
    trigger: dict | None = None,
    points_path: str | None = None,
) -> StreamingQuery:
    """PURGE events to the purge log, and, with ``points_path``, to the points table: the days that hold purged
    readings are written again without them.

    ``source`` has (value, arrival_ts); the purge takes effect at its arrival.
    Ids that fail the guard are set aside instead of stopping the job.  The log is written first: a batch that
    fails and runs again purges the same.  The job that writes points must not run at the same time.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        checked = device_id_guard(parse_purges(batch.select("value", "arrival_ts")))
        checked = checked.withColumnRenamed("arrival_ts", "purge_ts")
        good = checked.filter("device_id_ok").drop("device_id_ok")
        bad = checked.filter("NOT device_id_ok").drop("device_id_ok")
        write_events(good, "parquet", {"path": purges_path}, batch_id)
        write_events(bad, "parquet", {"path": quarantine_path}, batch_id)
        if points_path:
            purge_stored(batch.sparkSession, points_path, good)

    return start(source, write, checkpoint, trigger)


def run_view_tracking(
    source: DataFrame, devices: DataFrame, path: str, checkpoint: str, gap: str = VIEW_GAP, trigger: dict | None = None
) -> StreamingQuery:
    """Valid views of own active devices to the view history, a table that ``view_history`` reads.

    Views may come in any order and in any batch: a late one changes the history from its time on.
    """
    return stream_views(source, path, checkpoint, devices, gap, trigger)


def stream_trackable_views(views: DataFrame, devices: DataFrame) -> DataFrame:
    """Valid views of own active devices; ``devices`` is a static table."""
    return trackable_views(valid_views(views), devices)


def run_enrich(
    points: DataFrame, versions_path: str, path: str, checkpoint: str, trigger: dict | None = None
) -> StreamingQuery:
    """Readings with the name and target that the registry's versions give for their time.

    ``versions_path`` is a Parquet table as ``enrich_as_of`` needs it; it is read anew for each batch, so what is
    added to it counts from the next batch on."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        known = enrich_as_of(batch, spark.read.parquet(versions_path))
        write_batch(known, "parquet", {"path": path}, batch_id, run_of(spark))

    return start(points, write, checkpoint, trigger)


def drain(spark: SparkSession, stream: DataFrame, name: str) -> DataFrame:
    """Run ``stream`` over all available input and return what it wrote."""
    folder = shared_dir(spark, name)
    query = (
        stream.writeStream.format("parquet")
        .option("path", f"{folder}/out")
        .option("checkpointLocation", f"{folder}/checkpoint")
        .outputMode("append")
        .trigger(**AVAILABLE_NOW)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")
