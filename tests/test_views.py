import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from hearthline.operators import views
from tests.conftest import rows

T0 = datetime(2024, 1, 1)
VIEWS = "id bigint, user_id string, device_id string, viewed_at timestamp_ntz"
DEVICES = "device_id string, user_id string, name string, is_active boolean"


def brute_force(data, gap):
    kept, last = [], {}
    for id_, user, device, t in sorted(data, key=lambda r: (r[3], r[0])):
        before = last.get((user, device))
        if before is None or t - before > gap:
            last[user, device] = t
            kept.append(id_)
    return sorted(kept)


def throttled(spark, data, gap="1 minute"):
    return sorted(r["id"] for r in views.throttle_views(spark.createDataFrame(data, VIEWS), gap).collect())


def test_throttle_is_greedy(spark):
    data = [(i, "u", "d", T0 + timedelta(seconds=s)) for i, s in enumerate([0, 30, 60, 61, 121, 122])]
    assert throttled(spark, data) == [0, 3, 5]


@pytest.mark.parametrize("seed, span, steps", [(1, 900, 1), (2, 5000, 7), (3, 40_000, 61), (4, 100, 10)])
def test_throttle_of_a_hot_pair(spark, seed, span, steps):
    """A third of all views belong to one pair; long dense stretches cross slice borders."""
    random.seed(seed)
    data = []
    for i in range(6000):
        pair = ("u0", "d0") if i % 3 == 0 else (f"u{random.randrange(30)}", f"d{random.randrange(5)}")
        seconds = random.randrange(span) // steps * steps
        data.append((i, *pair, T0 + timedelta(seconds=seconds)))
    assert throttled(spark, data) == brute_force(data, timedelta(minutes=1))


def test_throttle_at_slice_borders(spark):
    """Every alignment of a steady chain with the ten-minute slices."""
    data, n = [], 0
    for shift in range(0, 61, 3):
        for step in (20, 59, 60, 61):
            for k in range(40):
                data.append((n, f"u{shift}", f"d{step}", T0 + timedelta(seconds=shift + step * k)))
                n += 1
    assert throttled(spark, data) == brute_force(data, timedelta(minutes=1))


@pytest.mark.parametrize("size", [1, 2, 7, 64])
def test_throttle_over_small_arrow_batches(spark, size):
    random.seed(5)
    data = [(i, "u", f"d{i % 2}", T0 + timedelta(seconds=random.randrange(8000))) for i in range(4000)]
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(size))
    try:
        assert throttled(spark, data) == brute_force(data, timedelta(minutes=1))
    finally:
        spark.conf.set(key, before)


def test_throttle_keeps_other_columns(spark):
    frame = spark.createDataFrame([(1, "u", "d", T0)], VIEWS).withColumn("page", F.lit("x"))
    assert rows(views.throttle_views(frame)) == [(1, "u", "d", T0, "x")]
    assert views.throttle_views(frame.limit(0)).count() == 0


def test_throttle_takes_instants(spark):
    data = [(i, "u", "d", T0 + timedelta(seconds=s)) for i, s in enumerate([0, 30, 61])]
    frame = spark.createDataFrame(data, VIEWS.replace("_ntz", ""))
    assert sorted(r["id"] for r in views.throttle_views(frame).collect()) == [0, 2]


@pytest.fixture()
def registry(spark):
    return spark.createDataFrame(
        [("a", "u1", "A", True), ("b", "u1", "B", False), ("c", "u2", "C", True)], DEVICES
    )


def test_only_own_active_devices_are_tracked(spark, registry):
    log = spark.createDataFrame(
        [(1, "u1", "a", T0), (2, "u1", "b", T0), (3, "u1", "c", T0), (4, "u2", "c", T0), (5, "u2", "zz", T0)], VIEWS
    )
    assert [r["id"] for r in views.trackable_views(log, registry).orderBy("id").collect()] == [1, 4]
    assert [r["id"] for r in views.rejected_views(log, registry).orderBy("id").collect()] == [2, 3, 5]


def test_top_devices(spark, registry):
    log = [(i, "u9", d, T0) for i, d in enumerate("aaabbbbcccc")]
    log.append((99, "u9", "a", T0 - timedelta(days=31)))
    got = views.top_devices(spark.createDataFrame(log, VIEWS), registry, "2024-01-31 00:00:00")
    assert rows(got) == [("u9", 1, "c", "C", 4), ("u9", 2, "a", "A", 3)]
    one = views.top_devices(spark.createDataFrame(log, VIEWS), registry, "2024-01-31 00:00:00", k=1)
    assert rows(one) == [("u9", 1, "c", "C", 4)]


def test_ids_of_views(spark):
    log = spark.createDataFrame(
        [(1, "u", "d", T0), (2, " ", "d", T0), (3, "u", None, T0), (4, "u" * 101, "d", T0), (5, "u" * 100, "d", T0)], VIEWS
    )
    assert [r["id"] for r in views.valid_views(log).orderBy("id").collect()] == [1, 5]


def test_retention_is_strict(spark):
    log = spark.createDataFrame([(1, "u", "d", T0), (2, "u", "d", T0 - timedelta(microseconds=1))], VIEWS)
    assert [r["id"] for r in views.retain_views(log, "2024-01-31 00:00:00", 30).collect()] == [1]
    assert [r["id"] for r in views.outdated_views(log, "2024-01-31 00:00:00", 30).collect()] == [2]


def test_recent_views(spark):
    log = spark.createDataFrame([(1, "u", "d", T0), (2, "u", "e", T0 - timedelta(seconds=1))], VIEWS)
    assert rows(views.recent_views(log, "2024-01-01 00:00:00")) == [("u", "d", True), ("u", "e", False)]
