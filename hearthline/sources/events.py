"""Event streams: Kafka in production, file formats wherever there is no broker."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

OFFSETS_PER_TRIGGER = "10000000"
FILES_PER_TRIGGER = "64"


def read_events(
    spark: SparkSession,
    format: str,
    options: dict[str, str],
    schema: StructType | None = None,
) -> DataFrame:
    """A streaming DataFrame from the beginning of the topic, resuming from its checkpoint.

    Kafka records come out as (value, partition, arrival, arrival_ts).  Times of arrival, then
    partitions and offsets give one order over all of them.  No watermark is set.
    The size of a micro-batch is limited, so that a backlog is worked off in
    steps; pass the limit in ``options`` to change it.
    """
    if format != "kafka":
        options = {"maxFilesPerTrigger": FILES_PER_TRIGGER, **options}
        return spark.readStream.format(format).schema(schema).options(**options).load()
    options = {"startingOffsets": "earliest", "maxOffsetsPerTrigger": OFFSETS_PER_TRIGGER, **options}
    records = spark.readStream.format("kafka").options(**options).load()
    return records.select(
        F.col("value").cast("string").alias("value"),
        F.col("partition").alias("partition"),
        F.col("offset").alias("arrival"),
        F.col("timestamp").alias("arrival_ts"),
    )


def run_of(spark: SparkSession) -> str:
    """The id of the streaming query in whose micro-batch this runs; it is kept in the checkpoint."""
    run = spark.sparkContext.getLocalProperty("sql.streaming.queryId")
    if not run:
        raise ValueError("not within a micro-batch")
    return run


def write_batch(
    batch: DataFrame, format: str, options: dict[str, str], batch_id: int, run: str, by: list[str] | None = None
) -> None:
    """Write one micro-batch to a folder of its own below that of its query.

    A batch that runs again replaces its output.  A query with a fresh checkpoint has
    another id and counts its batches anew without touching what is there.
    """
    options = dict(options)
    path = f"{options.pop('path')}/run={run}/batch={batch_id}"
    writer = batch.write.format(format).options(**options).mode("overwrite")
    (writer.partitionBy(*by) if by else writer).save(path)


def read_folders(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """What ``write_batch`` has written below ``path``, nothing if there is nothing."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def write_events(
    batch: DataFrame,
    format: str,
    options: dict[str, str],
    batch_id: int | None = None,
    run: str | None = None,
) -> None:
    """Write one batch of records.

    Files of a micro-batch go to ``run=<run>/batch=<id>``, see ``write_batch``; without a
    batch id they are added to what is there.  Kafka takes (key, value) and
    leaves the choice of partition to the key.
    """
    if format == "kafka":
        columns = [c for c in ("key", "value") if c in batch.columns]
        batch.select(*columns).write.format("kafka").options(**options).save()
    elif batch_id is None:
        batch.write.format(format).options(**options).mode("append").save()
    else:
        write_batch(batch, format, options, batch_id, run or run_of(batch.sparkSession))
