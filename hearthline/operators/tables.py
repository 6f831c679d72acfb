"""Reports on table mutations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def change_counts(changes: dict[str, DataFrame]) -> DataFrame:
    """Affected rows per named change set."""
    counts = [
        rows.agg(F.count(F.lit(1)).alias("affected")).select(F.lit(name).alias("operation"), "affected")
        for name, rows in changes.items()
    ]
    return reduce(DataFrame.unionByName, counts)
