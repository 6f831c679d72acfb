import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from hearthline.operators import series
from tests.conftest import rows

T0 = datetime(2024, 1, 1)
POINTS = "device_id string, ts timestamp, current_temperature double, target_temperature double, heating_status int, arrival bigint"
ID = "00000000-0000-4000-8000-000000000001"


def at(seconds):
    return T0 + timedelta(seconds=seconds)


def make(spark, points):
    return spark.createDataFrame([(ID, at(s), float(v), None, 0, i) for i, (s, v) in enumerate(points)], POINTS)


def test_history_bounds_and_stamps(spark):
    # as_of is 00:20:30, so the last minute bucket is cut by it.
    points = make(spark, [(0, 1), (1229, 3), (1230, 100), (1200, 2), (60, 7), (61, 8)])
    got = rows(series.telemetry_history(points, "-1h", "2024-01-01 00:20:30").drop("device_id"))
    assert got == [(at(60), 1.0), (at(120), 7.5), (at(1230), 2.5)]


def test_unknown_range_is_the_last_hour(spark):
    points = make(spark, [(0, 1), (4000, 2)])
    for range_ in ("-7d", None, ""):
        assert series.telemetry_history(points, range_, "2024-01-01 01:10:00").count() == 1


def test_history_rejects_odd_ids(spark):
    points = make(spark, [(0, 1)]).withColumn("device_id", F.lit("dev-1"))
    assert series.telemetry_history(points, "-1h", "2024-01-01 00:20:30").count() == 0


@pytest.mark.parametrize("mean, shown", [(-0.125, -0.12), (0.125, 0.13), (1.005, 1.0), (2.0, 2.0)])
def test_rounding(spark, mean, shown):
    assert rows(series.bucket_means(make(spark, [(0, mean)]), "1 minute"))[0][2] == shown


def test_merge_keeps_the_last_non_null(spark):
    writes = spark.createDataFrame(
        [
            (ID, at(0), 1.0, 20.0, 1, 1),
            (ID, at(0), 2.0, None, 0, 2),
            (ID, at(1), 5.0, None, 0, 3),
        ],
        POINTS,
    )
    assert rows(series.merge_points(writes)) == [
        (ID, at(0), 2.0, 20.0, 0, 2),
        (ID, at(1), 5.0, None, 0, 3),
    ]


@pytest.mark.parametrize("salts", [1, 7])
def test_last_n_of_a_hot_device(spark, salts):
    random.seed(1)
    data = [("hot" if random.random() < 0.8 else f"d{i % 9}", at(i), float(i), None, 0, i) for i in range(3000)]
    points = spark.createDataFrame(data, POINTS)
    got = series.last_n(points, 40, salts)
    want = {}
    for row in data:
        want.setdefault(row[0], []).append(row[5])
    got_by = {}
    for r in got.collect():
        got_by.setdefault(r["device_id"], []).append(r["arrival"])
    assert {k: sorted(v) for k, v in got_by.items()} == {k: v[-40:] for k, v in want.items()}


def test_tail_follows_history(spark):
    history = series.bucket_means(make(spark, [(0, 1), (60, 2), (120, 3)]), "1 minute")
    tail = make(spark, [(200, 4), (190, 5)])
    got = series.history_with_tail(history, tail, 3).orderBy("section", "arrival").collect()
    assert [r["temperature"] for r in got] == [3.0, 4.0, 5.0]


def _spans(times, gap):
    spans = []
    for t in sorted(times):
        if spans and t - spans[-1][1] <= gap:
            spans[-1] = (spans[-1][0], t, spans[-1][2] + 1)
        else:
            spans.append((t, t, 1))
    return spans


@pytest.mark.parametrize("slice_", ["20 seconds", "1 minute", "10 minutes"])
def test_online_intervals_do_not_depend_on_slices(spark, slice_):
    random.seed(2)
    data, want = [], []
    for d in range(6):
        times, now = [], 0
        for _ in range(300):
            now += random.choice([1, 2, 5, 9, 10, 10, 11, 30])
            times.append(now)
        data += [(f"d{d}", at(t), 0.0, None, 0, i) for i, t in enumerate(times)]
        want += [(f"d{d}", at(a), at(b), n, at(b + 10)) for a, b, n in _spans(times, 10)]
    points = spark.createDataFrame(data, POINTS)
    got = series.online_intervals(points, "10 seconds", slice_)
    assert rows(got) == sorted(want, key=lambda r: tuple(map(str, r)))


def test_staleness_and_health(spark):
    points = make(spark, [(0, 1), (50, 2)])
    stale = lambda as_of: series.stale_devices(points, as_of).first()["stale"]
    assert not stale("2024-01-01 00:01:00") and stale("2024-01-01 00:01:00.000001")
    healthy = lambda as_of: series.ingest_health(points, as_of).first()["healthy"]
    assert healthy("2024-01-01 00:02:49") and not healthy("2024-01-01 00:02:50")
    assert series.ingest_health(points.limit(0), "2024-01-01 00:00:00").first()["healthy"] is False


@pytest.mark.parametrize("slice_rows", [1, 7, 1000])
def test_late_arrivals_do_not_depend_on_slices(spark, slice_rows):
    random.seed(3)
    data, want, top = [], [], {}
    for i in range(400):
        d, t = random.choice(["hot", "hot", "a", "b"]), i * 10 - random.choice([0, 0, 0, 500])
        data.append((d, at(t), i, at(i * 10)))
        before = top.get(d)
        late = before is not None and before - t > 60
        want.append((i, None if before is None else at(before), (i * 10 - t) * 1_000_000, late))
        top[d] = t if before is None else max(before, t)
    points = spark.createDataFrame(data, "device_id string, ts timestamp, arrival bigint, arrival_ts timestamp")
    got = series.late_arrivals(points, "60 seconds", slice_rows)
    got = got.select("arrival", "seen_until", "lag_micros", "late").orderBy("arrival")
    assert [tuple(r) for r in got.collect()] == want


def test_purge_keeps_later_readings(spark):
    points = make(spark, [(0, 1), (10, 2), (11, 3)]).withColumn(
        "arrival_ts", F.when(F.col("arrival") == 0, F.lit(at(20)))
    )
    purges = spark.createDataFrame([(ID, at(5)), (ID, at(10)), ("x", at(99))], "device_id string, purge_ts timestamp")
    assert [r["arrival"] for r in series.purge_points(points, purges).collect()] == [2]
    late = series.purge_points(points, purges, "arrival_ts")
    assert sorted(r["arrival"] for r in late.collect()) == [0, 2]


def test_ranges(spark):
    requests = spark.createDataFrame([("-24h",), ("-6h",), ("-1h",), ("-2h",), (None,)], "range string")
    got = [(r["range"], r["bucket"], r["start"].hour) for r in series.history_ranges(requests, "2024-01-02 00:00:00").collect()]
    assert got == [
        ("-24h", "15 minutes", 0),
        ("-6h", "5 minutes", 18),
        ("-1h", "1 minute", 23),
        ("-2h", "1 minute", 23),
        (None, "1 minute", 23),
    ]
