"""Session settings and the shared folder that written intermediates go to."""

from __future__ import annotations

import sys
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import SparkSession

SETTINGS = {
    # All instants are compared and formatted in UTC.
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    # Fact-to-table joins keep the fact side on the left, so a device that holds
    # a large share of the rows is split by AQE instead of filling one task.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str, master: str | None = None, **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship_by_value(module: str) -> None:
    """Send the functions of ``module`` to Python workers inside each task, so that
    the package need not be installed on the executors."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``.

    Only a local-mode session without that setting may fall back to a temporary
    folder of this machine; on a cluster the other nodes could not see it.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all nodes share")
        root = tempfile.mkdtemp(prefix="hearthline-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
