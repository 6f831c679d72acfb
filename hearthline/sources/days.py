"""Tables of plain Parquet files in one folder a day, of which whole days are replaced.

Days are written with Spark's dynamic partition overwrite: files of the new days are staged first
and take the place of the old ones when all tasks are done, so a batch that lost executors or was
stopped is run again.  A day whose rows have all gone keeps one row without key, which readers
leave out.  One job at a time may write a table.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .events import read_folders

DATE = T.StructField("date", T.DateType())


def read_days(spark: SparkSession, path: str, schema: T.StructType, key: str) -> DataFrame:
    """The rows of all days with their ``date``; nothing if nothing is written yet."""
    return read_folders(spark, path, T.StructType([*schema.fields, DATE])).filter(F.col(key).isNotNull())


def days_of(rows: DataFrame) -> list[date]:
    """The days that occur in ``rows``; there are as many as a batch touches."""
    return [r.date for r in rows.select("date").distinct().collect()]


def within(rows: DataFrame, days: list[date]) -> DataFrame:
    return rows.filter(F.col("date").isin(days))


def replace_days(rows: DataFrame, days: list[date], path: str, *order: str) -> None:
    """Put ``rows``, sorted within files, in the place of all that ``days`` had.

    AQE merges small days into few files and splits a large day over several."""
    marks = rows.sparkSession.createDataFrame([(d,) for d in days], T.StructType([DATE]))
    full = rows.unionByName(marks, allowMissingColumns=True)
    (
        full.hint("rebalance", "date")
        .sortWithinPartitions("date", *order)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("date")
        .parquet(path)
    )


def revise_days(stored: DataFrame, old: DataFrame, new: DataFrame, path: str, *order: str) -> None:
    """``new`` in the place of ``old``, which are rows of ``stored``; only days with a difference are written."""
    old, new = old.select(*stored.columns).persist(), new.select(*stored.columns).persist()
    try:
        days = days_of(new.exceptAll(old).unionByName(old.exceptAll(new)))
        if days:
            kept = within(stored, days).exceptAll(within(old, days))
            replace_days(kept.unionByName(within(new, days)), days, path, *order)
    finally:
        old.unpersist()
        new.unpersist()
