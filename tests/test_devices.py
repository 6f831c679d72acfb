from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from hearthline import schemas
from hearthline.operators import access, claims, devices, tables
from tests.conftest import rows

NOW = datetime(2024, 1, 31)
AS_OF = "2024-01-31 00:00:00"


@pytest.fixture()
def registry(spark):
    return spark.createDataFrame(
        [
            (1, "active-device-A", "h", "user-1", "A", None, True, None, 21.0),
            (2, "inactive-device-B", "h", "user-1", "B", None, False, NOW - timedelta(days=40), None),
            (3, "active-device-C", "h", "user-2", "C", None, True, None, 150.0),
            (4, "inactive-device-D", "h", "user-2", "D", None, False, NOW - timedelta(days=30), None),
            (5, "inactive-device-E", "h", "user-2", "E", None, False, None, None),
        ],
        schemas.DEVICES,
    )


def ids(df):
    return sorted(r["device_id"] for r in df.collect())


def asks(spark, *pairs):
    return spark.createDataFrame(list(pairs), "device_id string, user_id string")


def test_lookups(spark, registry):
    both = asks(spark, ("active-device-A", "user-1"), ("active-device-C", "user-1"), ("inactive-device-B", "user-1"))
    assert ids(devices.active_devices(registry)) == ["active-device-A", "active-device-C"]
    assert ids(devices.active_devices(registry, both)) == ["active-device-A", "active-device-C"]
    assert ids(devices.active_devices(registry, both, ["device_id", "user_id"])) == ["active-device-A"]
    assert ids(devices.active_devices(registry, both, ["user_id"])) == ["active-device-A"]
    assert "inactive-device-B" in ids(devices.find_devices(registry, both, ["device_id"]))
    assert not {"id", "user_id", "hashed_device_token"} & set(devices.public_devices(registry).columns)


def test_soft_delete(spark, registry):
    requests = asks(
        spark, ("active-device-A", "user-1"), ("active-device-A", "user-1"), ("active-device-C", "user-1"), ("inactive-device-B", "user-1")
    )
    after = {r["device_id"]: r for r in devices.soft_delete(registry, requests, AS_OF).collect()}
    assert len(after) == 5
    assert (after["active-device-A"]["is_active"], after["active-device-A"]["deactivated_at"]) == (False, NOW)
    assert after["active-device-C"]["is_active"]
    assert after["inactive-device-B"]["deactivated_at"] == NOW - timedelta(days=40)
    assert rows(devices.soft_delete_outcomes(registry, requests)) == [
        ("active-device-A", "user-1", "DELETED"),
        ("active-device-C", "user-1", "NOT_FOUND"),
        ("inactive-device-B", "user-1", "NOT_FOUND"),
    ]
    resets = devices.command_events(devices.reset_requests(requests, registry))
    assert rows(resets) == [
        ("devices/active-device-A/commands", '{"command": "reset_device", "value": "active-d"}', 1, False)
    ]


def test_identity_events(spark, registry):
    events = spark.createDataFrame(
        [("DELETE_ACCOUNT", "user-1"), ("REGISTER", "user-2"), ("DELETE", None), ("DELETE", "\t "), (None, "user-2")],
        "type string, user_id string",
    )
    gone = devices.deleted_users(events)
    assert rows(gone) == [("user-1",)]
    after = {r["device_id"]: r for r in devices.deactivate_users(registry, gone, AS_OF).collect()}
    assert not after["active-device-A"]["is_active"] and after["active-device-C"]["is_active"]
    assert after["inactive-device-B"]["deactivated_at"] == NOW - timedelta(days=40)


def test_retention(spark, registry):
    assert ids(devices.expired_devices(registry, AS_OF, 30)) == ["inactive-device-B"]
    assert devices.retain_devices(registry, AS_OF, 30).count() == 4
    event = devices.purge_events(devices.expired_devices(registry, AS_OF, 30))
    assert rows(event) == [("inactive-device-B", '{"deviceId":"inactive-device-B","action":"PURGE"}')]
    none = devices.purge_events(devices.expired_devices(registry, AS_OF, 4000))
    assert none.count() == 0


@pytest.mark.parametrize(
    "value, temperature, reason",
    [
        ("25", 25.0, None),
        ("22.5", 22.5, None),
        (" 23.5 ", 23.5, None),
        ("-5", -5.0, None),
        ("-40", -40.0, None),
        ("100", 100.0, None),
        ("100.01", None, "OUT_OF_RANGE"),
        ("-40.5", None, "OUT_OF_RANGE"),
        ("1e2", 100.0, None),
        ("NaN", None, "NOT_A_NUMBER"),
        ("Infinity", None, "OUT_OF_RANGE"),
        ("hot", None, "NOT_A_NUMBER"),
        ("", None, "NOT_A_NUMBER"),
        (None, None, "MISSING"),
    ],
)
def test_temperature_commands(spark, value, temperature, reason):
    row = devices.validate_temperature(spark.createDataFrame([(value,)], "value string")).first()
    assert (row["temperature"], row["ok"], row["reason"]) == (temperature, reason is None, reason)


@pytest.mark.parametrize(
    "name, reason",
    [("Kitchen", None), (None, "BLANK"), ("", "BLANK"), (" \t", "BLANK"), ("x" * 50, None), ("x" * 51, "TOO_LONG"), ("😀" * 26, "TOO_LONG"), ("😀" * 25, None)],
)
def test_renames(spark, name, reason):
    row = devices.validate_rename(spark.createDataFrame([(name,)], "name string")).first()
    assert (row["ok"], row["reason"]) == (reason is None, reason)


def test_commands_apply_in_order_and_only_to_own_active_devices(spark, registry):
    commands = spark.createDataFrame(
        [
            ("active-device-A", "user-1", "25", "Hall", 1),
            ("active-device-A", "user-1", "30", None, 2),
            ("active-device-A", "user-1", "500", "  ", 3),
            ("active-device-C", "user-1", "30", "Stolen", 4),
            ("inactive-device-B", "user-1", "30", "Dead", 5),
        ],
        "device_id string, user_id string, value string, name string, seq bigint",
    )
    after = {r["device_id"]: (r["name"], r["target_temperature"]) for r in devices.apply_commands(registry, commands).collect()}
    assert after["active-device-A"] == ("Hall", 30.0)
    assert after["active-device-C"] == ("C", 150.0)
    assert after["inactive-device-B"] == ("B", None)
    sent = devices.command_events(devices.temperature_requests(commands, registry))
    assert rows(sent) == [
        ("devices/active-device-A/commands", '{"command": "set_target_temp", "value": 25.0}', 1, True),
        ("devices/active-device-A/commands", '{"command": "set_target_temp", "value": 30.0}', 1, True),
    ]


@pytest.mark.parametrize(
    "current, target, heating, device, status",
    [
        (20.0, 21.0, 1, "active-device-A", "HEATING"),
        (20.95, 21.0, 1, "active-device-A", "IDLE"),
        (22.0, 21.0, 1, "active-device-A", "COOLING"),
        (10.0, 21.0, 0, "active-device-A", "IDLE"),
        (20.0, None, 1, "active-device-A", "HEATING"),
        (21.5, None, 1, "active-device-C", "HEATING"),
        (22.5, None, 1, "unknown", "COOLING"),
    ],
)
def test_hvac_status(spark, registry, current, target, heating, device, status):
    point = spark.createDataFrame(
        [(device, current, target, heating)],
        "device_id string, current_temperature double, target_temperature double, heating_status int",
    )
    assert devices.hvac_status(devices.enrich(point, registry)).first()["status"] == status


DEV, BRIDGE = "active-device-A", "bridge"
ACCESS = [
    (DEV, 2, f"iot/telemetry/{DEV}", True, "own_telemetry"),
    (DEV, 2, f"iot/telemetry/{DEV}/", False, "foreign_write"),
    (DEV, 2, f"iot/telemetry/{DEV}/x", False, "foreign_write"),
    (DEV, 2, "iot/telemetry/active-device-C", False, "foreign_write"),
    (DEV, 2, f"IOT/telemetry/{DEV}", False, "foreign_write"),
    (DEV, 2, None, False, "foreign_write"),
    (DEV, 1, f"devices/{DEV}/commands", True, "own_commands"),
    (DEV, 4, f"devices/{DEV}/commands", True, "own_commands"),
    (DEV, 4, f"devices/{DEV}/commands/", False, "not_permitted"),
    (DEV, 1, f"iot/telemetry/{DEV}", False, "not_permitted"),
    (DEV, 4, None, False, "not_permitted"),
    (DEV, 99, f"devices/{DEV}/commands", False, "not_permitted"),
    (DEV, None, f"devices/{DEV}/commands", False, "not_permitted"),
    ("inactive-device-B", 2, "iot/telemetry/inactive-device-B", False, "inactive_device"),
    ("unknown", 1, "devices/unknown/commands", False, "inactive_device"),
    (None, 1, "x", False, "inactive_device"),
    (BRIDGE, 1, "iot/telemetry/x", True, "bridge_telemetry"),
    (BRIDGE, 4, "iot/telemetry/+", True, "bridge_telemetry"),
    (BRIDGE, 4, "iot/telemetry", False, "inactive_device"),
    (BRIDGE, 1, None, False, "inactive_device"),
    (BRIDGE, 2, "devices/x/commands", True, "bridge_command"),
    (BRIDGE, 2, "devices/x/commands//", True, "bridge_command"),
    (BRIDGE, 2, "devices//commands", False, "inactive_device"),
    (BRIDGE, 2, "devices/x/y/commands", False, "inactive_device"),
    (BRIDGE, 2, "iot/telemetry/x", False, "inactive_device"),
    ("BRIDGE", 1, "iot/telemetry/x", False, "inactive_device"),
]


def test_access_rules(spark, registry):
    requests = spark.createDataFrame([(i, *c[:3]) for i, c in enumerate(ACCESS)], "n int, username string, acc int, topic string")
    decisions = access.evaluate_access(requests, registry, BRIDGE)
    got = [(r["allowed"], r["rule"]) for r in decisions.orderBy("n").collect()]
    assert got == [c[3:] for c in ACCESS]
    assert access.security_alerts(decisions).count() == sum(c[4] == "foreign_write" for c in ACCESS)
    assert access.access_report(decisions).agg(F.sum("requests")).first()[0] == len(ACCESS)
    without = access.evaluate_access(requests, registry, None)
    assert without.filter("rule LIKE 'bridge%'").count() == 0


def test_claims(spark):
    t = lambda s: NOW + timedelta(seconds=s)
    codes = spark.createDataFrame(
        [(1, "123-456", "u1", t(0)), (2, "123-456", "u2", t(400)), (3, "111-111", "u3", t(290)), (4, "222-222", "u4", t(0)), (5, "222-222", "u5", t(10))],
        "issue_id bigint, code string, user_id string, issued_at timestamp",
    )
    asked = spark.createDataFrame(
        [
            (10, "123-456", t(-1)), (11, "123-456", t(0)), (12, "123-456", t(1)), (13, "123-456", t(699)),
            (14, "111-111", t(589)), (15, "111-111", t(600)), (16, "999-000", t(5)), (17, "222-222", t(20)),
            (18, "222-222", t(21)), (19, "123456", t(0)),
        ],
        "claim_id bigint, code string, claimed_at timestamp",
    )
    resolved = claims.resolve_claims(codes, claims.valid_claims(asked))
    won = {r["claim_id"]: (r["issue_id"], r["user_id"]) for r in resolved.collect() if r["status"] == "CLAIMED"}
    assert won == {11: (1, "u1"), 13: (2, "u2"), 14: (3, "u3"), 17: (5, "u5")}
    assert resolved.count() == 9


def test_expired_codes_are_not_found(spark):
    codes = spark.createDataFrame([(1, "123-456", "u", NOW)], "issue_id bigint, code string, user_id string, issued_at timestamp")
    asked = spark.createDataFrame(
        [(1, "123-456", NOW + timedelta(minutes=5))], "claim_id bigint, code string, claimed_at timestamp"
    )
    assert claims.resolve_claims(codes, asked).first()["status"] == "NOT_FOUND"
    assert claims.resolve_claims(codes, asked, "6 minutes").first()["status"] == "CLAIMED"


def test_provisioning(spark, registry):
    claimed = spark.createDataFrame(
        [(9, "abcd1234", "t", "user-7")], "id bigint, device_id string, hashed_device_token string, user_id string"
    )
    after = devices.provision(registry, claimed)
    assert after.schema.names == registry.schema.names and after.count() == 6
    new = after.filter("id = 9").first()
    assert (new["name"], new["is_active"], new["target_temperature"]) == ("New Device abcd", True, 20.0)


def test_change_counts(registry):
    counts = tables.change_counts({"a": registry, "b": registry.filter("is_active")})
    assert rows(counts) == [("a", 5), ("b", 2)]
