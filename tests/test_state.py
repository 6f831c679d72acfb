"""Streams with state, in several micro-batches, against their batch twins; the registry as a table."""

import time

import pytest
from pyspark.sql import functions as F

from hearthline import streaming as S
from hearthline.operators import devices, series
from hearthline.plans.catalog import instants, plain
from hearthline.session import shared_dir
from hearthline.sources.events import read_events
from hearthline.sources.registry import change_registry, read_registry, write_registry
from hearthline.streaming.state import joined
from tests.conftest import rows

NOW = {"availableNow": True}
POINT = "device_id string, ts timestamp, current_temperature double, arrival long, arrival_ts timestamp"


def at(seconds):
    return f"2024-01-01 {seconds // 3600:02d}:{seconds % 3600 // 60:02d}:{seconds % 60:02d}"


@pytest.fixture()
def feed(spark):
    """A stream of the given parts, a file and micro-batch each."""

    def make(*parts):
        path = shared_dir(spark, "parts")
        for k, part in enumerate(parts):
            data = [(d, t, float(t), 100 * k + i, t) for i, (d, t) in enumerate(part)]
            frame = spark.createDataFrame([(d, at(t), c, a, at(t)) for d, t, c, a, _ in data], "device_id string, ts string, current_temperature double, arrival long, arrival_ts string")
            frame = frame.select("device_id", F.col("ts").cast("timestamp").alias("ts"), "current_temperature", "arrival", F.col("arrival_ts").cast("timestamp").alias("arrival_ts"))
            frame.coalesce(1).write.mode("append").parquet(path)
            time.sleep(0.05)
        stream = read_events(spark, "parquet", {"path": path, "maxFilesPerTrigger": "1"}, frame.schema)
        return stream, spark.read.schema(frame.schema).parquet(path)

    return make


PARTS = [
    [("a", 0), ("a", 5), ("b", 3)],
    [("a", 14), ("b", 30), ("a", 9)],
    [("a", 60), ("c", 61), ("b", 38)],
    [("b", 20), ("c", 200)],
]


def test_alarms_when_the_watermark_has_passed(spark, feed):
    stream, batch = feed(*PARTS[:3], [("c", 200)])
    got = S.drain(spark, S.stale_alarms(stream, "10 seconds", "40 seconds"), "alarms")
    want = series.online_intervals(batch, "10 seconds").filter("stale_from <= '2024-01-01 00:02:40'")
    assert want.count() == 5 and rows(got.select(*want.columns)) == rows(want)


def test_spans_join_in_any_order():
    import numpy as np

    spans = joined(np.array([30, 0, 11, 5]), np.array([30, 4, 20, 11]), np.array([1, 2, 3, 4]), 6)
    assert spans == [(0, 20, 9), (30, 30, 1)]


def test_late_readings_have_a_table_of_their_own(spark, feed):
    stream, batch = feed(*PARTS)
    folder = shared_dir(spark, "judged")
    S.stream_judged(stream, folder, f"{folder}/checkpoint", "5 seconds", NOW).awaitTermination()
    want = series.late_arrivals(batch, "5 seconds")
    for name, late in (("on_time", False), ("late", True)):
        got = spark.read.parquet(f"{folder}/{name}").select("device_id", "ts", "arrival", "seen_until", "lag_micros", "late")
        assert rows(got) == rows(want.filter(F.col("late") == late).select(*got.columns))
    counts = spark.read.parquet(f"{folder}/counts").agg(F.sum("on_time"), F.sum("late")).first()
    assert tuple(counts) == (batch.count() - 1, 1) and want.filter("late").count() == 1


def test_closed_means_and_corrections(spark, feed):
    stream, batch = feed(*PARTS[:3], [("c", 200)], [("c", 201)], [("b", 20)])
    closed = S.drain(spark, S.closed_means(stream, "10 seconds", "5 seconds"), "means")
    whole = series.bucket_means(batch, "10 seconds").filter("timestamp <= '2024-01-01 00:03:16'")
    missing = S.corrections(closed, whole)
    said = {(r.device_id, r.timestamp): r.temperature for r in closed.collect()}
    true = {(r.device_id, r.timestamp): r.temperature for r in whole.collect()}
    assert {(r.device_id, r.timestamp) for r in missing.collect()} == {k for k, v in true.items() if said.get(k) != v}
    assert missing.count() >= 1  # b at 20 came when the watermark was at 195
    for k, v in said.items():
        assert v == true[k] or k in {(r.device_id, r.timestamp) for r in missing.collect()}


def test_names_as_of_the_reading(spark):
    points = spark.createDataFrame(
        [("a", t) for t in (1, 5, 5, 9, 90_000, 200_000)] + [("b", 5), (None, 5)], "device_id string, t int"
    ).select("device_id", F.timestamp_seconds("t").alias("ts"))
    points = points.unionByName(spark.createDataFrame([("a", None)], "device_id string, ts timestamp"))
    versions = spark.createDataFrame(
        [("a", 5, 1, "one"), ("a", 5, 2, "two"), ("a", 9, 3, None), ("a", 90_001, 4, "four"), ("b", 6, 5, "late")],
        "device_id string, t int, seq long, name string",
    ).select("device_id", F.timestamp_seconds("t").alias("valid_from"), "seq", "name", F.col("seq").cast("double").alias("target_temperature"))
    got = devices.enrich_as_of(points, versions).select("device_id", F.unix_seconds("ts").alias("t"), "name", "stored_target")
    assert rows(got) == rows(
        spark.createDataFrame(
            [("a", 1, None, None), ("a", 5, "two", 2.0), ("a", 5, "two", 2.0), ("a", 9, None, 3.0), ("a", 90_000, None, 3.0),
             ("a", 200_000, "four", 4.0), ("b", 5, None, None), (None, 5, None, None), ("a", None, None, None)],
            "device_id string, t long, name string, stored_target double",
        )
    )
    assert devices.enrich_as_of(points.limit(0), versions).count() == 0
    assert devices.enrich_as_of(points, versions.limit(0)).count() == points.count()


def test_only_changed_buckets_are_written(spark, inputs):
    path, table = shared_dir(spark, "registry"), instants(inputs.devices(), "deactivated_at")
    write_registry(table, path, 8)
    assert rows(plain(read_registry(spark, path))) == rows(inputs.devices())
    files = lambda: {r[0] for r in spark.read.parquet(path).select(F.input_file_name()).distinct().collect()}
    before = files()
    one = inputs.devices().filter("is_active").orderBy("id").limit(1)
    change = lambda old: devices.soft_delete(old, one, "2024-02-01 00:00:00")
    assert change_registry(spark, path, one, change, 8) == 1
    assert len(before - files()) == len(files() - before) == 1
    want = devices.soft_delete(inputs.devices(), one, "2024-02-01 00:00:00")
    assert rows(plain(read_registry(spark, path)).select("id", "is_active")) == rows(want.select("id", "is_active"))
    assert change_registry(spark, path, one, change, 8) == 0  # again: nothing to do
    everyone = lambda old: old.limit(0)
    change_registry(spark, path, inputs.devices(), everyone, 8)
    assert read_registry(spark, path).count() == 0
