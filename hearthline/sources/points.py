"""The points table: plain Parquet files in one folder a day (see ``days``), each point (device_id, ts) once.

A batch is merged with the days that it touches, and these days are replaced.  Merging is
idempotent, so a batch that is written again changes nothing, whoever writes it.  Reading
needs no merging and hence no shuffle, and prunes days.  A purge writes the days that hold readings
of purged devices again, after which these are gone from the disk.

Each write costs as much as its days: let a trigger wait until that pays, and give late data of many
days a job of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..operators.series import merge_points, purge_points
from .days import days_of, read_days, replace_days, within

_ORDER = ("device_id", "ts")


def _rows(points: DataFrame) -> DataFrame:
    if not {"arrival", "arrival_ts"} & set(points.columns):
        raise ValueError("points need arrival or arrival_ts: later writes of a point win")
    columns = [
        (F.col(f.name) if f.name in points.columns else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in schemas.POINTS.fields
    ]
    return points.select(*columns).withColumn("date", F.to_date("ts"))


def _stored(spark: SparkSession, path: str) -> DataFrame:
    return read_days(spark, path, schemas.POINTS, "device_id")


def upsert_points(batch: DataFrame, path: str, purges: DataFrame | None = None) -> None:
    """Merge a batch of points into the table; later writes of a point win.

    With ``purges`` (device_id, purge_ts), what had arrived before a purge of its device is left out, on both
    sides and before they are merged, so that a batch that runs again after a purge brings nothing back."""
    rows = _rows(batch).filter("device_id IS NOT NULL AND ts IS NOT NULL")
    days = days_of(rows)
    if not days:
        return
    both = within(_stored(batch.sparkSession, path), days).unionByName(rows)
    if purges is not None:
        both = purge_points(both, purges, arrived_at="arrival_ts")
    replace_days(_rows(merge_points(both)), days, path, *_ORDER)


def purge_stored(spark: SparkSession, path: str, purges: DataFrame) -> int:
    """Take the readings that had arrived before a purge of their device off the disk; returns the number of
    days written.  Other days are not touched."""
    stored = _stored(spark, path)
    latest = purges.groupBy("device_id").agg(F.max("purge_ts").alias("purge_ts"))
    arrived = F.greatest("ts", F.coalesce("arrival_ts", "ts"))
    days = days_of(stored.join(latest, "device_id").filter(arrived <= F.col("purge_ts")))
    if days:
        left = purge_points(within(stored, days), purges, arrived_at="arrival_ts")
        replace_days(_rows(left), days, path, *_ORDER)
    return len(days)


def read_points(
    spark: SparkSession,
    path: str,
    start: str | None = None,
    stop: str | None = None,
    purges: DataFrame | None = None,
) -> DataFrame:
    """Points with ``start <= ts < stop``; only the days in between are read.

    With ``purges``, what had arrived before a purge is left out even if the table still has it.
    The day stays as column ``date``, so that operators that filter by time prune too."""
    points = _stored(spark, path)
    if start is not None:
        since = F.lit(start).cast("timestamp")
        points = points.filter((F.col("ts") >= since) & (F.col("date") >= F.to_date(since)))
    if stop is not None:
        until = F.lit(stop).cast("timestamp")
        points = points.filter((F.col("ts") < until) & (F.col("date") <= F.to_date(until)))
    return points if purges is None else purge_points(points, purges, arrived_at="arrival_ts")
