"""Plans under skew: one device holds most of the rows."""

import pytest
from pyspark.sql import functions as F

from hearthline.operators import access, devices, series, views
from tests.conftest import rows

JOINS = {
    # No broadcast, and partitions count as skewed early.
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10KB",
    "spark.sql.shuffle.partitions": "8",
}


@pytest.fixture()
def early_skew(spark):
    before = {k: spark.conf.get(k, None) for k in JOINS}
    for k, v in JOINS.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.fixture()
def registry(spark):
    return spark.range(200).select(
        F.concat(F.lit("d"), "id").alias("device_id"),
        F.concat(F.lit("u"), F.col("id") % 7).alias("user_id"),
        F.concat(F.lit("name "), "id").alias("name"),
        F.lit(None).cast("string").alias("location"),
        (F.col("id") % 3 != 1).alias("is_active"),
        F.lit(20.0).alias("target_temperature"),
    )


@pytest.fixture()
def hot(spark):
    """60,000 rows, nine of ten on device d0."""
    n = F.when(F.col("id") % 10 < 9, 0).otherwise(F.col("id") % 200)
    return spark.range(0, 60_000, 1, 6).select(
        F.concat(F.lit("d"), n.cast("int")).alias("device_id"),
        F.concat(F.lit("u"), (n % 7).cast("int")).alias("user_id"),
        F.timestamp_seconds(F.col("id") * 3).alias("ts"),
        F.rand(1).alias("current_temperature"),
        F.lit(None).cast("double").alias("target_temperature"),
        F.lit(1).alias("heating_status"),
        F.col("id").alias("arrival"),
    )


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_joins_split_the_hot_device(early_skew, hot, registry):
    requests = hot.withColumnRenamed("device_id", "username").select(
        "username", F.lit(2).alias("acc"), F.lit("iot/telemetry/d0").alias("topic"), "arrival"
    )
    purges = registry.select("device_id", F.lit("1970-01-01 01:00:00").cast("timestamp").alias("purge_ts"))
    for joined in (
        devices.enrich(hot, registry),
        devices.owned_requests(hot, registry),
        devices.denied_requests(hot, registry),
        views.active_views(hot, registry),
        access.evaluate_access(requests, registry, "bridge"),
        series.purge_points(hot, purges, salts=2),
    ):
        plan = final_plan(joined)
        assert "SortMergeJoin(skew=true)" in plan, plan[:3000]


def test_counts_shrink_before_the_join(hot, registry):
    log = hot.withColumnRenamed("ts", "viewed_at")
    plan = views.top_devices(log, registry, "1970-01-02 00:00:00")._jdf.queryExecution().optimizedPlan().toString()
    join = next(i for i, line in enumerate(plan.splitlines()) if "Join" in line)
    below = "\n".join(plan.splitlines()[join:])
    assert "Aggregate [user_id" in below and "count(1)" in below


def test_last_n_sends_few_rows_of_the_hot_device(spark, hot):
    got = series.last_n(hot, 5, salts=8)
    plan = final_plan(got)
    assert plan.count("WindowGroupLimit") >= 4
    want = hot.groupBy("device_id").agg(F.slice(F.sort_array(F.collect_list("arrival"), False), 1, 5).alias("a"))
    want = want.select("device_id", F.explode("a").alias("arrival"))
    assert rows(got.select("device_id", "arrival")) == rows(want)


def test_hot_device_is_one_long_span(hot):
    spans = series.online_intervals(hot.filter("device_id = 'd0'"), "10 seconds", "10 minutes").collect()
    assert [s["readings"] for s in spans] == [hot.filter("device_id = 'd0'").count()]


def test_scans_read_only_what_they_need(spark, inputs):
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    plan = series.telemetry_history(inputs.points(), "-1h", "2024-01-31 00:00:00")
    text = plan._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "ReadSchema: struct<ts:timestamp_ntz,user_id:bigint,value:double>" in text
    assert "GreaterThanOrEqual(ts,2024-01-30T23:00)" in text and "LessThan(ts,2024-01-31T00:00)" in text
