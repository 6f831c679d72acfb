"""The device registry as a table: plain Parquet files in buckets by a hash of the device id.

A change names the devices it may touch.  Their buckets are read, changed by an operator and, where they came
out otherwise, written in place of the old ones with dynamic partition overwrite; other files stay as they are.
One job at a time may write.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from .events import read_folders

BUCKETS = 256
_BUCKET = T.StructField("bucket", T.IntegerType())
_ALL = T.StructType([*schemas.DEVICES.fields, _BUCKET])


def _bucketed(devices: DataFrame, buckets: int) -> DataFrame:
    return devices.withColumn("bucket", F.pmod(F.xxhash64("device_id"), F.lit(buckets)).cast("int"))


def _stored(spark: SparkSession, path: str) -> DataFrame:
    return read_folders(spark, path, _ALL).filter("id IS NOT NULL")


def _write(devices: DataFrame, path: str, emptied: list[int]) -> None:
    marks = devices.sparkSession.createDataFrame([(b,) for b in emptied], T.StructType([_BUCKET]))
    (
        devices.unionByName(marks, allowMissingColumns=True)
        .hint("rebalance", "bucket")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("bucket")
        .parquet(path)
    )


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    return _stored(spark, path).select(*schemas.DEVICES.fieldNames())


def write_registry(devices: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """The first load."""
    columns = [F.col(f.name).cast(f.dataType).alias(f.name) for f in schemas.DEVICES.fields]
    _write(_bucketed(devices.select(*columns), buckets), path, [])


def change_registry(
    spark: SparkSession,
    path: str,
    touched: DataFrame,
    change: Callable[[DataFrame], DataFrame],
    buckets: int = BUCKETS,
) -> int:
    """Apply ``change`` to the devices of the buckets that ``touched`` (device_id) falls into; returns how many
    buckets were written.

    ``change`` gets registry rows and returns what shall be in their place, new devices included; it
    must leave devices alone that are not among ``touched``."""
    hit = [r.bucket for r in _bucketed(touched.select("device_id"), buckets).select("bucket").distinct().collect()]
    old = _stored(spark, path).filter(F.col("bucket").isin(hit)).persist()
    columns = [F.col(f.name).cast(f.dataType).alias(f.name) for f in schemas.DEVICES.fields]
    new = _bucketed(change(old.select(*schemas.DEVICES.fieldNames())).select(*columns), buckets).persist()
    try:
        other = new.exceptAll(old).unionByName(old.exceptAll(new)).select("bucket").distinct()
        changed = [r.bucket for r in other.collect()]  # at most ``buckets`` numbers
        if changed:
            _write(new.filter(F.col("bucket").isin(changed)), path, changed)
        return len(changed)
    finally:
        old.unpersist()
        new.unpersist()
