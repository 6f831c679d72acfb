"""Each stream, fed in several micro-batches, gives what its batch twin gives."""

import time

import pytest
from pyspark.sql import functions as F

from hearthline import streaming as S
from hearthline.operators import claims, ingest, series, views
from hearthline.operators.devices import purge_events
from hearthline.plans.catalog import instants
from hearthline.plans.inputs import CLAIM_LIFE, Inputs
from hearthline.session import shared_dir
from hearthline.sources.events import read_events, write_events
from hearthline.sources.points import purge_stored, read_points, upsert_points
from tests.conftest import DATA, rows

NOW = {"availableNow": True}
PARTS = 3


@pytest.fixture(scope="module")
def feed(spark):
    """The events as files in time order."""
    path = shared_dir(spark, "feed")
    events = spark.read.parquet(f"{DATA}/events.parquet")
    total = events.count()
    for part in range(PARTS):
        low, high = part * total // PARTS, (part + 1) * total // PARTS
        chunk = events.filter((F.col("event_id") >= low) & (F.col("event_id") < high))
        chunk.coalesce(1).write.mode("append").parquet(path)
        time.sleep(0.05)
    return path


@pytest.fixture()
def live(spark, feed):
    def make():
        schema = spark.read.parquet(feed).schema
        options = {"path": feed, "maxFilesPerTrigger": "1"}
        return Inputs(spark, DATA, read_events(spark, "parquet", options, schema))

    return make


def test_ingest_job(spark, live, inputs):
    folder = shared_dir(spark, "ingest")
    query = S.run_ingest(
        live().raw().select("value", "arrival"),
        f"{folder}/points",
        ("parquet", {"path": f"{folder}/processed"}),
        ("parquet", {"path": f"{folder}/dlq"}),
        f"{folder}/checkpoint",
        NOW,
    )
    query.awaitTermination()
    parsed = ingest.parse_telemetry(inputs.raw().select("value", "arrival"))
    events = ingest.valid_telemetry(parsed)
    stored = read_points(spark, f"{folder}/points").drop("arrival_ts", "partition", "date")
    assert rows(stored) == rows(series.merge_points(ingest.to_points(events)).select(*stored.columns))
    processed = spark.read.parquet(f"{folder}/processed").select("key", "value")
    assert rows(processed) == rows(ingest.keyed_records(events).select("key", "value"))
    assert rows(spark.read.parquet(f"{folder}/dlq").select("value")) == rows(ingest.dead_letters(parsed))
    progress = [p for p in query.recentProgress if p["numInputRows"]]
    assert len(progress) == PARTS
    counts = ingest.validity_counts(parsed).first()
    observed = [p["observedMetrics"]["telemetry"] for p in progress]
    assert sum(o["telemetry_valid"] for o in observed) == counts["telemetry_valid"]
    assert sum(o["telemetry_invalid"] for o in observed) == counts["telemetry_invalid"]
    # The second half of the history only reads the days it needs.
    late = read_points(spark, f"{folder}/points", start="2024-01-20 00:00:00", stop="2024-01-25 00:00:00")
    want = stored.filter("ts >= '2024-01-20' AND ts < '2024-01-25'")
    assert rows(late.select(*stored.columns)) == rows(want)
    assert "PartitionFilters: [isnotnull(date" in late._jdf.queryExecution().executedPlan().toString()


def plain_plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def on_disk(spark, path):
    """Rows of all files, by day, without the rows that mark a day."""
    return spark.read.parquet(path).filter("device_id IS NOT NULL")


def files(spark, path):
    return {r[0] for r in spark.read.parquet(path).select(F.input_file_name()).distinct().collect()}


def test_writing_a_batch_again_changes_nothing(spark, inputs):
    path = shared_dir(spark, "points")
    writes = instants(inputs.writes(), "ts")
    upsert_points(writes.filter("arrival < 500"), path)
    upsert_points(writes.filter("arrival >= 400"), path)
    once = rows(read_points(spark, path))
    upsert_points(writes.filter("arrival < 500"), path)  # also an older batch
    upsert_points(writes.filter("arrival >= 400"), path)
    assert rows(read_points(spark, path)) == once
    assert rows(read_points(spark, path).drop("arrival_ts", "partition", "date")) == rows(series.merge_points(writes))
    assert "Aggregate" not in plain_plan(read_points(spark, path))


def test_batches_of_any_writer_lose_nothing(spark, inputs):
    """Six points, three at a time, by writers that count their batches from 0 each."""
    path = shared_dir(spark, "six")
    six = instants(inputs.points(), "ts").limit(6).persist()
    at = six.orderBy("arrival").collect()[3]["arrival"]
    for _ in range(2):
        upsert_points(six.filter(F.col("arrival") < at), path)
        upsert_points(six.filter(F.col("arrival") >= at), path)
    assert read_points(spark, path).count() == 6


def test_only_touched_days_are_written(spark, inputs):
    path = shared_dir(spark, "touched")
    points = instants(inputs.points(), "ts")
    early = points.filter("ts < '2024-01-20'")
    upsert_points(early, path)
    before = files(spark, path)
    late = points.filter("ts >= '2024-01-19 12:00:00' AND ts < '2024-01-22'")
    upsert_points(late, path)
    new = files(spark, path) - before
    assert {f.split("date=")[1][:10] for f in new} == {"2024-01-19", "2024-01-20", "2024-01-21"}
    want = points.filter("ts < '2024-01-22'")
    assert rows(read_points(spark, path).select("device_id", "ts")) == rows(want.select("device_id", "ts").distinct())
    # A purge: only days of the device are written, and its readings leave the disk.
    before, device = files(spark, path), late.first()["device_id"]
    purges = spark.createDataFrame([(device,)], "device_id string").withColumn("purge_ts", F.lit("2024-01-19").cast("timestamp"))
    gone = want.filter((F.col("device_id") == device) & (F.col("ts") <= "2024-01-19")).select("device_id", "ts").distinct()
    assert purge_stored(spark, path, purges) == gone.select(F.to_date("ts")).distinct().count() > 0
    kept = want.select("device_id", "ts").distinct().exceptAll(gone)
    assert rows(on_disk(spark, path).select("device_id", "ts")) == rows(kept)
    new = {f.split("date=")[1][:10] for f in files(spark, path) - before}
    assert new == {str(r[0]) for r in gone.select(F.to_date("ts")).distinct().collect()}
    assert purge_stored(spark, path, purges) == 0
    # A day that loses all its rows, and a batch from before the purge that runs again.
    all_of = purges.crossJoin(points.select(F.col("device_id").alias("d")).distinct()).select(F.col("d").alias("device_id"), "purge_ts")
    purge_stored(spark, path, all_of)
    assert on_disk(spark, path).filter("ts <= '2024-01-19'").count() == 0
    left = rows(read_points(spark, path))
    upsert_points(early, path, all_of)
    assert len(rows(read_points(spark, path))) == len(left)


def purges_at(devices, at):
    return purge_events(devices).select("value", F.lit(at).cast("timestamp_ntz").alias("purge_ts"))


def test_purge_job(spark, inputs):
    folder = shared_dir(spark, "purge")
    busy = inputs.points().select("device_id").distinct().orderBy("device_id").limit(3)
    mine = purges_at(busy, "2024-01-15 00:00:00")
    events = instants(inputs.purges().unionByName(mine), "purge_ts").withColumnRenamed("purge_ts", "arrival_ts")
    write_events(events, "parquet", {"path": f"{folder}/events"})
    points = instants(inputs.points(), "ts")
    upsert_points(points, f"{folder}/points")
    S.run_purge(
        read_events(spark, "parquet", {"path": f"{folder}/events"}, events.schema),
        f"{folder}/purges", f"{folder}/quarantine", f"{folder}/checkpoint", NOW, f"{folder}/points",
    ).awaitTermination()
    purges = spark.read.parquet(f"{folder}/purges").select("device_id", "purge_ts")
    quarantine = spark.read.parquet(f"{folder}/quarantine")
    assert quarantine.count() > 0 and quarantine.filter("device_id NOT LIKE 'dev-%'").count() == 0
    columns = ["device_id", "ts", "current_temperature", "target_temperature", "heating_status", "arrival"]
    left = series.merge_points(series.purge_points(points, purges)).select(*columns)
    assert rows(on_disk(spark, f"{folder}/points").select(*columns)) == rows(left)
    # A reading that arrives after its device's purge comes back.
    device = purges.join(points, "device_id").first()["device_id"]
    again = points.filter(F.col("device_id") == device).withColumn("arrival_ts", F.lit("2024-06-01").cast("timestamp"))
    upsert_points(again, f"{folder}/points", purges)
    left = read_points(spark, f"{folder}/points", purges=purges).select(*columns)
    want = series.purge_points(points, purges.filter(F.col("device_id") != device))
    assert rows(left) == rows(series.merge_points(want).select(*columns))


def test_a_new_run_overwrites_nothing(spark, inputs):
    """Jobs with fresh checkpoints over the same folders."""
    folder, schema = shared_dir(spark, "again"), spark.read.parquet(f"{DATA}/events.parquet").schema
    halves = []
    for k in range(2):
        part = f"{folder}/events{k}"
        spark.read.parquet(f"{DATA}/events.parquet").filter(f"event_id % 2 = {k}").coalesce(1).write.parquet(part)
        halves.append(Inputs(spark, DATA, read_events(spark, "parquet", {"path": part}, schema)))
    points = f"{folder}/points"
    upsert_points(instants(inputs.writes(), "ts"), points)
    before = read_points(spark, points).count()
    for k, half in enumerate(halves):
        S.run_ingest(
            half.raw().select("value", "arrival"), points, ("parquet", {"path": f"{folder}/processed"}),
            ("parquet", {"path": f"{folder}/dlq"}), f"{folder}/checkpoint{k}", NOW,
        ).awaitTermination()
        S.stream_views(half.views(), f"{folder}/views", f"{folder}/view-checkpoint{k}", gap="1 day", trigger=NOW).awaitTermination()
    parsed = ingest.parse_telemetry(inputs.raw().select("value", "arrival"))
    events = ingest.valid_telemetry(parsed)
    new = ingest.to_points(events).select("device_id", "ts").distinct()
    assert before > 0
    both = new.unionByName(instants(inputs.writes(), "ts").select("device_id", "ts")).distinct()
    assert read_points(spark, points).count() == both.count()
    assert spark.read.parquet(f"{folder}/processed").count() == events.count()
    assert spark.read.parquet(f"{folder}/dlq").count() == ingest.dead_letters(parsed).count()
    kept = S.view_history(spark, f"{folder}/views", inputs.views().schema)
    assert rows(kept) == rows(views.throttle_views(inputs.views(), "1 day"))


def test_order_of_arrival_and_lost_order(spark, inputs):
    path = shared_dir(spark, "order")
    schema = "device_id string, ts timestamp, current_temperature double, target_temperature double, heating_status int, partition int, arrival long"
    at = instants(inputs.points(), "ts").first()["ts"]
    spark_rows = [("d", at, 1.0, None, 0, 0, 5), ("d", at, 2.0, None, 1, 1, 5), ("d", at, None, 9.0, 1, 0, 7), ("e", at, 4.0, 5.0, 1, None, None)]
    upsert_points(spark.createDataFrame(spark_rows, schema), path)
    got = {r.device_id: r for r in read_points(spark, path).collect()}
    assert (got["d"].current_temperature, got["d"].target_temperature) == (2.0, 9.0)
    assert (got["e"].current_temperature, got["e"].target_temperature, got["e"].heating_status) == (4.0, 5.0, 1)
    with pytest.raises(ValueError):
        upsert_points(spark.createDataFrame(spark_rows, schema).drop("arrival"), path)


def test_history_over_the_store_reads_its_days_only(spark, inputs):
    path = shared_dir(spark, "days")
    upsert_points(instants(inputs.points(), "ts"), path)
    history = series.telemetry_history(read_points(spark, path), "-24h", "2024-01-31 00:00:00")
    plan = history._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date" in plan


@pytest.fixture(scope="module", params=[(1, "64"), (80, "20"), (200, "64")])
def shuffled(request, spark):
    """The events as files in no order of time: (number of files, files per trigger)."""
    files, limit = request.param
    path = shared_dir(spark, "shuffled")
    events = spark.read.parquet(f"{DATA}/events.parquet")
    events.repartition(files, F.xxhash64("event_id")).write.parquet(path)
    options = {"path": path, "maxFilesPerTrigger": limit}
    return lambda: Inputs(spark, DATA, read_events(spark, "parquet", options, events.schema))


def test_streams_do_not_depend_on_order_or_cuts(spark, shuffled, inputs):
    folder = shared_dir(spark, "any-order")
    at = lambda name: (f"{folder}/{name}", f"{folder}/{name}-checkpoint")
    everyone = inputs.views().select("device_id", "user_id").distinct().withColumn("is_active", F.lit(True))
    late = lambda x: x.replayed_points()
    asked = claims.valid_claims(shuffled().claims())
    for query in [
        S.stream_views(shuffled().views(), *at("views"), gap="1 day", trigger=NOW),
        S.run_view_tracking(shuffled().views(), everyone, *at("tracking"), "1 day", NOW),
        S.stream_claims(shuffled().codes(), asked, *at("claims"), CLAIM_LIFE, NOW),
        S.stream_history(instants(shuffled().points(), "ts"), "1 hour", *at("history"), NOW),
        S.stream_staleness(instants(shuffled().points(), "ts"), *at("spans"), "3 hours", "1 day", NOW),
        S.stream_late_arrivals(late(shuffled()), *at("late"), NOW),
    ]:
        query.awaitTermination()
    log = lambda name: at(name)[0]
    want = rows(views.throttle_views(inputs.views(), "1 day"))
    schema = inputs.views().schema
    assert rows(S.view_history(spark, log("views"), schema)) == want
    assert rows(S.view_history(spark, log("tracking"), schema)) == want
    resolved = claims.resolve_claims(inputs.codes(), claims.valid_claims(inputs.claims()), CLAIM_LIFE)
    got = S.claim_answers(spark, log("claims"), asked.schema["claimed_at"].dataType)
    assert rows(got.select(*resolved.columns)) == rows(resolved)
    batch = instants(inputs.points(), "ts")
    assert rows(S.history(spark, log("history"))) == rows(series.bucket_means(batch, "1 hour"))
    last = batch.agg(F.date_trunc("MILLISECOND", F.max("ts"))).first()[0]
    spans = series.online_intervals(batch, "3 hours", "1 day")
    assert rows(S.online(spark, log("spans"), "3 hours", "1 day")) == rows(spans)
    closed = S.online(spark, log("spans"), "3 hours", "1 day", closed=True)
    assert rows(closed) == rows(spans.filter(F.col("stale_from") <= F.lit(last)))
    points = late(inputs)
    judged = series.late_arrivals(points, "10 minutes")
    assert judged.filter("late").count() > 0
    assert rows(S.lateness(spark, log("late"), points.schema, "10 minutes")) == rows(judged)


def test_means_do_not_depend_on_the_split(spark, inputs):
    points = inputs.points()
    want = rows(series.bucket_means(points.coalesce(1), "1 day"))
    for parts in (7, 40):
        assert rows(series.bucket_means(points.repartition(parts), "1 day")) == want


def test_tracked_views_stream(spark, live, inputs):
    own = S.stream_trackable_views(live().views(), inputs.devices())
    got = S.drain(spark, own, "own")
    want = views.trackable_views(views.valid_views(inputs.views()), inputs.devices())
    assert rows(got.select("id")) == rows(want.select("id"))
