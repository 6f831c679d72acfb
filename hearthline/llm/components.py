"""Connected components of a graph of links, by labels that sink to the smallest id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import written


def components(links: DataFrame, files: int | None = None) -> DataFrame:
    """(a, b) to (id, label): the smallest id of the component of every linked id.

    In each round an id takes the smallest label among its own and its neighbours',
    and then the label of that label; long chains shrink by half a round.  Each
    round is written, as so many ``files``, so a lost executor costs no more than a round.
    """
    both = written(
        links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(),
        "links",
        files,
    )
    labels = written(
        both.groupBy("a").agg(F.min("b").alias("low")).select(
            F.col("a").alias("id"), F.least("a", "low").alias("label")
        ),
        "labels",
        files,
    )
    while True:
        near = (
            both.join(labels.select(F.col("id").alias("b"), "label"), "b")
            .groupBy("a")
            .agg(F.min("label").alias("low"))
        )
        sunk = labels.join(near.withColumnRenamed("a", "id"), "id").select(
            "id", F.col("label").alias("old"), F.least("label", "low").alias("mid")
        )
        jump = labels.select(F.col("id").alias("mid"), F.col("label").alias("far"))
        stepped = written(
            sunk.join(jump, "mid").select("id", "old", F.least("mid", "far").alias("label")), "labels", files
        )
        labels = stepped.select("id", "label")
        if stepped.filter("label < old").isEmpty():
            return labels
