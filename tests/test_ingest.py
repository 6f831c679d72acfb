import json

import pytest
from pyspark.sql import functions as F

from hearthline.operators import ingest
from tests.conftest import rows

ID = "00000000-0000-4000-8000-000000000001"
TIME = "2024-01-01T00:00:07.179575Z"


def reading(device=ID, ts=TIME, data='{"currentTemperature":21.5}', extra=""):
    quoted = lambda v: v if v.startswith(("{", "[", '"')) or v in ("null", "7", "true") else f'"{v}"'
    return f'{{"deviceId":{quoted(device)},"timestamp":{ts if ts[0].isdigit() and "T" not in ts else quoted(ts)},"data":{data}{extra}}}'


CASES = {
    "plain": (reading(), True),
    "unknown field": (reading(extra=',"more":{"deviceId":{}}'), True),
    "number as id": (reading(device="7"), True),
    "boolean as id": (reading(device="true"), True),
    "object as id": (reading(device='{"a":1}'), False),
    "array as id": (reading(device='["a"]'), False),
    "text that looks like an object as id": (reading(device='"{a}"'), True),
    "null id": (reading(device="null"), False),
    "blank id": (reading(device='" \\t\\u2003"'), False),
    "no-break space is not blank": (reading(device='"\\u00a0"'), True),
    "nul in id": (reading(device='"a\\u0000b"'), False),
    "epoch seconds": (reading(ts="1704067207"), True),
    "epoch with fraction": (reading(ts="1704067207.25"), True),
    "null time": (reading(ts="null"), False),
    "time without offset": (reading(ts="2024-01-01T00:00:07"), False),
    "time with offset": (reading(ts="2024-01-01T01:00:07+01:00"), True),
    "quoted number": (reading(data='{"currentTemperature":"21.5"}'), True),
    "empty number is null": (reading(data='{"currentTemperature":""}'), False),
    "word as number": (reading(data='{"currentTemperature":"warm"}'), False),
    "boolean as number": (reading(data='{"currentTemperature":true}'), False),
    "object as number": (reading(data='{"currentTemperature":{}}'), False),
    "empty target is null": (reading(data='{"currentTemperature":1,"targetTemperature":""}'), True),
    "word as target": (reading(data='{"currentTemperature":1,"targetTemperature":"x"}'), False),
    "integer flag": (reading(data='{"currentTemperature":1,"heatingStatus":1}'), True),
    "quoted flag": (reading(data='{"currentTemperature":1,"heatingStatus":"true"}'), True),
    "quoted integer flag": (reading(data='{"currentTemperature":1,"heatingStatus":"1"}'), False),
    "fraction as flag": (reading(data='{"currentTemperature":1,"heatingStatus":1.5}'), False),
    "word as flag": (reading(data='{"currentTemperature":1,"heatingStatus":"yes"}'), False),
    "text as data": (reading(data='"x"'), False),
    "array as data": (reading(data="[1]"), False),
    "null data": (reading(data="null"), False),
    "extreme temperature": (reading(data='{"currentTemperature":-5000}'), True),
    "trailing garbage": (reading() + " tail", True),
    "cut off": (reading()[:-1], False),
    "single quotes": (reading().replace('"', "'"), False),
    "not a number token": (reading(data='{"currentTemperature":NaN}'), False),
    "empty": ("", False),
    "null document": ("null", False),
    "array document": ("[1]", False),
    "array of readings": (f"[{reading()}]", False),
    "not json": ("not json", False),
    "null value": (None, False),
}


def test_every_row_goes_to_exactly_one_branch(spark):
    raw = spark.createDataFrame([(k, v) for k, (v, _) in CASES.items()], "name string, value string")
    parsed = ingest.parse_telemetry(raw)
    got = {r["name"]: r["valid"] for r in parsed.collect()}
    assert got == {k: ok for k, (_, ok) in CASES.items()}
    valid, invalid = ingest.valid_telemetry(parsed), ingest.invalid_telemetry(parsed)
    assert valid.count() + invalid.count() == len(CASES)
    dead = [r["value"] for r in ingest.dead_letters(parsed).collect()]
    assert sorted(map(str, dead)) == sorted(str(v) for v, ok in CASES.values() if not ok)
    counts = ingest.validity_counts(parsed).first()
    assert (counts["telemetry_valid"], counts["telemetry_invalid"]) == (valid.count(), invalid.count())


def test_json_is_decoded_once_per_row(spark):
    raw = spark.createDataFrame([("{}",)], "value string")
    plan = ingest.valid_telemetry(ingest.parse_telemetry(raw))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("StructField(timestamp,StringType,true)") == 1


def test_points_and_encoding(spark):
    raw = spark.createDataFrame(
        [
            (reading(data='{"currentTemperature":21.5,"targetTemperature":null,"heatingStatus":true}'), 1),
            (reading(ts="2024-01-01T00:00:07Z", data='{"currentTemperature":1,"heatingStatus":false}'), 2),
            (reading(ts="2024-01-01T00:00:07.5Z"), 3),
        ],
        "value string, arrival bigint",
    )
    events = ingest.valid_telemetry(ingest.parse_telemetry(raw))
    points = ingest.to_points(events).orderBy("arrival").collect()
    assert [p["heating_status"] for p in points] == [1, 0, 0]
    assert points[0]["ts"].microsecond == 179000
    texts = [r["value"] for r in ingest.encode_telemetry(events).orderBy("arrival").collect()]
    decoded = [json.loads(t) for t in texts]
    assert decoded[0] == {
        "deviceId": ID,
        "timestamp": TIME,
        "data": {"currentTemperature": 21.5, "targetTemperature": None, "heatingStatus": True},
    }
    assert [d["timestamp"] for d in decoded[1:]] == ["2024-01-01T00:00:07Z", "2024-01-01T00:00:07.500Z"]
    assert {r["key"] for r in ingest.keyed_records(events).collect()} == {ID}


def test_purge_events_are_filtered_and_guarded(spark):
    good = f'{{"deviceId":"{ID}","action":"PURGE","more":1}}'
    values = [
        good,
        good.replace("PURGE", "purge"),
        "broken",
        '{"action":"PURGE"}',
        '{"deviceId":"dev-1","action":"PURGE"}',
        f'{{"deviceId":"{ID}\\u0000","action":"PURGE"}}',
        '{"deviceId":{"a":1},"action":"PURGE"}',
        f'{{"deviceId":"{ID}\\n","action":"PURGE"}}',
    ]
    raw = spark.createDataFrame([(v,) for v in values], "value string")
    checked = ingest.device_id_guard(ingest.parse_purges(raw))
    assert rows(checked) == sorted(
        [(ID, True), (ID, True), (None, False), ("dev-1", False), (ID + "\n", False)],
        key=lambda r: tuple(map(str, r)),
    )


@pytest.mark.parametrize(
    "topic, key",
    [
        ("iot/telemetry/a", "a"),
        ("iot/telemetry/", ""),
        ("iot/telemetry", None),
        ("iot/telemetry/a/b", None),
        ("iot/telemetry/a/", None),
        ("iot/other/a", None),
        ("/iot/telemetry/a", None),
        (None, None),
    ],
)
def test_topics(spark, topic, key):
    messages = spark.createDataFrame([(topic, "p")], "topic string, payload string")
    row = ingest.route_messages(messages).first()
    assert (row["key"], row["route"]) == (key, "invalid" if key is None else "telemetry")
    assert ingest.live_routes(ingest.route_messages(messages)).count() == (1 if key else 0)


def test_metrics_of_nothing(spark):
    none = spark.createDataFrame([], "topic string, payload string")
    row = ingest.ingest_metrics(none).first()
    assert (row["received"], row["success_rate"]) == (0, 0.0)


def test_devices_seen(inputs):
    exact = ingest.devices_seen_count(inputs.messages()).first()["devices"]
    assert exact == ingest.devices_seen(inputs.messages()).count()
    sketch = ingest.devices_seen_count(inputs.messages(), approximate=True).first()["devices"]
    assert abs(sketch - exact) <= max(1, exact * 0.15)


@pytest.mark.parametrize(
    "text, valid",
    [("inf", False), ("nan", False), ("+inf", False), ("infinity", False), ("NaN", True), ("INF", True), ("-Infinity", True),
     ("1d", True), ("1e2", True), (".5", True), ("5.", True), ("0x10", False), ("1_0", False), ("--1", False)],
)
def test_spelling_of_quoted_numbers(spark, text, valid):
    raw = spark.createDataFrame([(reading(data=f'{{"currentTemperature":"{text}"}}'),)], "value string")
    assert ingest.parse_telemetry(raw).first()["valid"] is valid


def test_filter_on_valid_parses_nothing_again(inputs):
    parsed = ingest.parse_telemetry(inputs.raw())
    plan = ingest.valid_telemetry(parsed)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Filter valid") == 1 and "rlike" not in plan.lower().split("generate")[0]


def test_means_leave_out_what_is_not_finite(spark):
    from hearthline.operators.series import bucket_means

    schema = "device_id string, ts timestamp_ntz, current_temperature double"
    at = spark.sql("SELECT TIMESTAMP_NTZ '2024-01-01 00:01:00' AS t").first()["t"]
    table = spark.createDataFrame([("d", at, 1.0), ("d", at, float("nan")), ("d", at, float("inf")), ("d", at, 1.01), ("d", at, -2.0)], schema)
    assert [r.temperature for r in bucket_means(table, "1 hour").collect()] == [0.0]
    below = table.filter("current_temperature = 1.01").withColumn("current_temperature", F.lit(-0.125))
    assert [r.temperature for r in bucket_means(below, "1 hour").collect()] == [-0.12]
