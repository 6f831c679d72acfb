"""Reading the given tables, and written intermediates in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import shared_dir


def long_texts(spark: SparkSession) -> None:
    """Whole texts go to Python in small batches: what a task holds is bounded by their number."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "16m")


def free_name(df: DataFrame, name: str) -> str:
    """A column name that begins so and that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def written(df: DataFrame, name: str, files: int | None = None) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts the lineage, so that a lost
    executor costs a read and not the work before it.

    ``files``: how many are written, for small tables out of many partitions.  Where Hadoop's native library is missing each file makes the
    executor's JVM start three processes to set modes, and until each has started its memory counts twice.
    """
    spark = df.sparkSession
    path = shared_dir(spark, name)
    (df.repartition(files) if files else df).write.parquet(path)
    return spark.read.parquet(path)
