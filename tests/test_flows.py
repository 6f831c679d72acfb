from pyspark.sql import functions as F

from hearthline.operators import devices, series, views
from hearthline.plans import flows
from hearthline.plans.inputs import AS_OF
from tests.conftest import rows


def test_retention_parts_add_up(inputs):
    log, table = inputs.views(), inputs.devices()
    kept = flows.retention(log, table, AS_OF, 10)
    assert kept.views.count() + views.outdated_views(log, AS_OF, 10).count() == log.count()
    assert kept.devices.count() + kept.purges.count() == table.count()
    assert kept.devices.join(kept.purges, F.col("device_id") == F.col("key")).count() == 0


def test_history_only_for_owners(inputs, spark):
    points, table = inputs.points(), inputs.devices()
    owner = table.filter("is_active").join(points, "device_id", "left_semi").orderBy("device_id").first()
    asks = [(owner["device_id"], owner["user_id"], "-24h"), (owner["device_id"], "user-none", "-6h")]
    requests = spark.createDataFrame(asks, "device_id string, user_id string, range string")
    got = flows.requested_history(points, table, requests, AS_OF)
    want = series.telemetry_history(points, "-24h", AS_OF).filter(F.col("device_id") == owner["device_id"])
    assert rows(got.drop("range")) == rows(want)
    assert rows(got.select("range").distinct()) in ([], [("-24h",)])
    unknown = spark.createDataFrame([(*asks[0][:2], "-9d")], requests.schema)
    assert got.schema == flows.requested_history(points, table, unknown, AS_OF).schema


def test_requested_history_scans_the_points_once(inputs):
    requests = inputs.commands().withColumn("range", F.lit("-24h"))
    got = flows.requested_history(inputs.points(), inputs.devices(), requests, AS_OF)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    # Once for the points, once for the requests derived from the same table.
    assert plan.count("events.parquet") + plan.count("Relation [event_id") == 2


def test_histories_of_instants_equal_those_of_wall_clocks(inputs, spark):
    points = inputs.points()
    asked = points.select("device_id").distinct().withColumn("range", F.lit("-6h"))
    timed = points.withColumn("ts", F.from_utc_timestamp(F.col("ts").cast("timestamp"), "UTC"))
    for table in (points, timed):
        got = series.telemetry_histories(table, asked, AS_OF).drop("range")
        assert rows(got) == rows(series.telemetry_history(table, "-6h", AS_OF))
