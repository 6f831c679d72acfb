from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas


def load_table(spark: SparkSession, name: str, source: dict[str, str]) -> DataFrame:
    """A registry table with its declared column types.

    ``source`` is ``{"format": "parquet", "path": ...}`` or the options of a JDBC
    read (``{"format": "jdbc", "url": ..., "dbtable": ...}``); for a large JDBC
    table pass ``partitionColumn``, ``lowerBound``, ``upperBound`` and
    ``numPartitions`` so that the read is split.
    """
    options = dict(source)
    reader = spark.read.format(options.pop("format", "parquet"))
    table = reader.options(**options).load()
    return table.select(
        *[F.col(f.name).cast(f.dataType).alias(f.name) for f in schemas.TABLES[name].fields]
    )
