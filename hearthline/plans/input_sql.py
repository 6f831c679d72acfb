"""DuckDB twins of ``inputs``: one named query per derived input."""

from __future__ import annotations


def _device(number: str) -> str:
    return f"'00000000-0000-4000-8000-' || lpad(CAST({number} AS VARCHAR), 12, '0')"


_CODE = "'100-1' || lpad(CAST(event_id % 20 AS VARCHAR), 2, '0')"

SQL = {
    "devices": f"""
        SELECT c_custkey AS id, {_device('c_custkey')} AS device_id, md5(c_name) AS hashed_device_token,
               'user-' || CAST(c_nationkey AS VARCHAR) AS user_id, c_name AS name, n_name AS location,
               c_acctbal >= 0 AS is_active,
               CASE WHEN c_acctbal < 0
                    THEN TIMESTAMP '2024-01-31 00:00:00' - to_days(CAST(c_custkey % 60 AS INTEGER)) END
                    AS deactivated_at,
               CASE WHEN c_custkey % 10 <> 0 THEN CAST(15 + c_custkey % 11 AS DOUBLE) END AS target_temperature
        FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "raw": f"""
        SELECT event_id, event_id AS arrival, CASE WHEN event_id % 20 = 0 THEN 'not json' ELSE
            '{{' || CASE event_id % 20
                     WHEN 1 THEN '' WHEN 2 THEN '"deviceId":"  ",'
                     WHEN 9 THEN '"deviceId":"' || {_device('user_id')} || '\\u0000",'
                     ELSE '"deviceId":"' || {_device('user_id')} || '",' END
            || '"timestamp":"' || CASE WHEN event_id % 20 = 5 THEN 'bad'
                                       ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') END || '"'
            || CASE WHEN event_id % 20 = 4 THEN '' ELSE
                 ',"data":{{"currentTemperature":' || CASE event_id % 20
                     WHEN 3 THEN 'null' WHEN 6 THEN '"21.5"'
                     ELSE CAST((CAST(round(value * 100) AS BIGINT) % 14001 - 4000) / CAST(100 AS DOUBLE)
                               AS VARCHAR) END
                 || ',"targetTemperature":' || CASE WHEN event_id % 20 = 10 THEN '"abc"'
                     WHEN event_id % 3 = 0 THEN 'null' ELSE '21.0' END
                 || ',"heatingStatus":' || CASE WHEN event_id % 2 = 0 THEN 'true' ELSE 'false' END
                 || '}}' END
            || CASE WHEN event_id % 20 = 7 THEN ',"extra":{{"a":[1]}}' ELSE '' END || '}}' END AS value
        FROM events""",
    "fields": """
        SELECT event_id, arrival, value, json_valid(value) AS is_json,
               CASE WHEN json_valid(value) THEN CAST(json_extract(value, '$.deviceId') AS VARCHAR) END AS id_json,
               CASE WHEN json_valid(value) THEN json_extract_string(value, '$.timestamp') END AS ts_text,
               CASE WHEN json_valid(value) THEN json_extract_string(value, '$.data.currentTemperature') END AS current_text,
               CASE WHEN json_valid(value) THEN json_extract_string(value, '$.data.targetTemperature') END AS target_text,
               CASE WHEN json_valid(value) THEN json_extract_string(value, '$.data.heatingStatus') END AS heating_text
        FROM raw""",
    "parsed": """
        SELECT event_id, arrival, value, trim(id_json, '"') AS device_id,
               TRY_CAST(replace(replace(ts_text, 'T', ' '), 'Z', '') AS TIMESTAMP) AS ts,
               TRY_CAST(current_text AS DOUBLE) AS current_temperature,
               TRY_CAST(target_text AS DOUBLE) AS target_temperature,
               TRY_CAST(heating_text AS BOOLEAN) AS heating,
               coalesce(is_json AND trim(trim(id_json, '"')) <> '' AND NOT contains(id_json, '\\u0000')
                 AND TRY_CAST(replace(replace(ts_text, 'T', ' '), 'Z', '') AS TIMESTAMP) IS NOT NULL
                 AND TRY_CAST(current_text AS DOUBLE) IS NOT NULL
                 AND (target_text IS NULL OR TRY_CAST(target_text AS DOUBLE) IS NOT NULL)
                 AND (heating_text IS NULL OR TRY_CAST(heating_text AS BOOLEAN) IS NOT NULL), false) AS valid
        FROM fields""",
    "points": f"""
        SELECT {_device('user_id')} AS device_id, ts, value AS current_temperature,
               CASE WHEN event_id % 3 <> 0 THEN CAST(21 AS DOUBLE) END AS target_temperature,
               CASE WHEN event_id % 2 = 0 THEN 1 ELSE 0 END AS heating_status, event_id AS arrival
        FROM events""",
    "writes": """
        SELECT device_id, date_trunc('day', ts) AS ts, current_temperature, target_temperature,
               heating_status, arrival FROM points""",
    "replayed_points": f"""
        SELECT {_device('user_id')} AS device_id,
               ts - to_minutes(CASE WHEN event_id % 7 = 0 THEN event_id % 500 ELSE 0 END) AS ts,
               event_id AS arrival, ts AS arrival_ts
        FROM events""",
    "views": f"""
        SELECT event_id AS id, 'user-' || CAST(user_id % 25 AS VARCHAR) AS user_id,
               {_device("CAST(json_extract_string(props, '$.k') AS BIGINT) % 10")} AS device_id,
               ts AS viewed_at
        FROM events WHERE event_type = 'view'""",
    "dense_views": """
        SELECT v.* REPLACE (TIMESTAMP '2024-01-01' + to_seconds(id * 37 % 900) AS viewed_at) FROM views v""",
    "dense_points": """
        SELECT p.* REPLACE (TIMESTAMP '2024-01-01' + to_seconds(arrival * 37 % 900) AS ts) FROM points p""",
    "faulty_views": """
        SELECT v.* REPLACE (
            CASE WHEN id % 7 = 0 THEN ' ' || chr(9) WHEN id % 11 = 0 THEN repeat('u', 101)
                 WHEN id % 13 = 0 THEN repeat('u', 100) WHEN id % 17 = 0 THEN NULL ELSE user_id END AS user_id,
            CASE WHEN id % 7 = 1 THEN ' ' || chr(9) WHEN id % 11 = 1 THEN repeat('u', 101)
                 WHEN id % 13 = 1 THEN repeat('u', 100) WHEN id % 17 = 1 THEN NULL ELSE device_id END AS device_id)
        FROM views v""",
    "messages": f"""
        SELECT event_id, ts, CASE event_id % 5
                 WHEN 1 THEN 'iot/telemetry/' || {_device('user_id')} || '/x'
                 WHEN 2 THEN 'iot/telemetry/'
                 WHEN 3 THEN 'iot/other/' || {_device('user_id')}
                 ELSE 'iot/telemetry/' || {_device('user_id')} END AS topic,
               props AS payload, event_id % 40 <> 0 AS delivered
        FROM events""",
    "routed": """
        SELECT event_id, ts, delivered, payload AS value,
               CASE WHEN len(string_split(topic, '/')) = 3 AND topic LIKE 'iot/telemetry/%'
                    THEN string_split(topic, '/')[3] END AS key,
               CASE WHEN len(string_split(topic, '/')) = 3 AND topic LIKE 'iot/telemetry/%'
                    THEN 'telemetry' ELSE 'invalid' END AS route
        FROM messages""",
    "access_requests": f"""
        SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'bridge' ELSE {_device('user_id')} END AS username,
               CASE event_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 4 ELSE 99 END AS acc,
               CASE (event_id // 4) % 6
                 WHEN 0 THEN 'iot/telemetry/' || {_device('user_id')}
                 WHEN 1 THEN 'iot/telemetry/' || {_device('user_id + 1')}
                 WHEN 2 THEN 'devices/' || {_device('user_id')} || '/commands'
                 WHEN 3 THEN 'devices/' || {_device('user_id')} || '/commands/'
                 WHEN 4 THEN 'devices//commands' END AS topic
        FROM events""",
    "decisions": """
        SELECT r.*, rule IN ('bridge_telemetry', 'bridge_command', 'own_telemetry', 'own_commands') AS allowed
        FROM (SELECT a.*, CASE
                WHEN username = 'bridge' AND acc IN (1, 4) AND starts_with(topic, 'iot/telemetry/') THEN 'bridge_telemetry'
                WHEN username = 'bridge' AND acc = 2
                     AND regexp_full_match(topic, 'devices/[^/]+/commands/*') THEN 'bridge_command'
                WHEN NOT EXISTS (SELECT 1 FROM devices d WHERE d.device_id = a.username AND d.is_active)
                     THEN 'inactive_device'
                WHEN acc = 2 THEN CASE WHEN topic = 'iot/telemetry/' || username THEN 'own_telemetry'
                                       ELSE 'foreign_write' END
                WHEN acc IN (1, 4) AND topic = 'devices/' || username || '/commands' THEN 'own_commands'
                ELSE 'not_permitted' END AS rule
              FROM access_requests a) r""",
    "codes": f"""
        SELECT event_id AS issue_id, {_CODE} AS code, 'user-' || CAST(user_id % 25 AS VARCHAR) AS user_id,
               ts AS issued_at
        FROM events WHERE event_type = 'signup'""",
    "claims": f"""
        SELECT event_id AS claim_id, CASE WHEN event_id % 13 = 0 THEN replace({_CODE}, '-', '')
                                          ELSE {_CODE} END AS code, ts AS claimed_at
        FROM events WHERE event_type = 'purchase'""",
    "resolved": """
        SELECT claim_id, code, claimed_at,
               CASE WHEN turn = 1 THEN issue_id END AS issue_id,
               CASE WHEN turn = 1 THEN user_id END AS user_id,
               CASE WHEN turn = 1 THEN 'CLAIMED' ELSE 'NOT_FOUND' END AS status
        FROM (SELECT m.*, CASE WHEN issue_id IS NOT NULL THEN
                     row_number() OVER (PARTITION BY issue_id ORDER BY claimed_at, claim_id) END AS turn
              FROM (SELECT c.claim_id, c.code, c.claimed_at,
                           CASE WHEN c.claimed_at < k.issued_at + INTERVAL 12 HOUR THEN k.issue_id END AS issue_id,
                           k.user_id
                    FROM claims c ASOF LEFT JOIN codes k
                         ON c.code = k.code AND c.claimed_at >= k.issued_at
                    WHERE regexp_full_match(c.code, '[0-9]{3}-[0-9]{3}')) m) t""",
    "claim_identities": f"""
        SELECT event_id AS claim_id, event_id + 1000000000 AS id,
               {_device('event_id + 500000000000')} AS device_id,
               md5(CAST(event_id AS VARCHAR)) AS hashed_device_token
        FROM events WHERE event_type = 'purchase'""",
    "identity_events": """
        SELECT CASE event_id % 4 WHEN 0 THEN 'DELETE_ACCOUNT' WHEN 1 THEN 'DELETE_ACCOUNT_ADMIN'
                                 WHEN 2 THEN 'REGISTER' END AS type,
               CASE WHEN event_id % 11 = 0 THEN ' '
                    ELSE 'user-' || CAST(user_id % 25 AS VARCHAR) END AS user_id,
               ts AS time
        FROM events WHERE event_type = 'error'""",
    "gone_users": """
        SELECT DISTINCT user_id FROM identity_events WHERE contains(type, 'DELETE') AND trim(user_id) <> ''""",
    "commands": f"""
        SELECT {_device('user_id')} AS device_id,
               CASE WHEN (event_id // 6) % 3 = 2 THEN 'user-none'
                    ELSE 'user-' || CAST(c_nationkey AS VARCHAR) END AS user_id,
               CASE event_id % 6 WHEN 0 THEN '21' WHEN 1 THEN '-40' WHEN 2 THEN '100.5' WHEN 3 THEN 'abc'
                                 WHEN 5 THEN 'NaN' END AS value,
               CASE (event_id // 6) % 4 WHEN 0 THEN 'Room ' || CAST(event_id AS VARCHAR) WHEN 1 THEN '  '
                                        WHEN 3 THEN repeat('x', 51) END AS name,
               event_id AS seq
        FROM events JOIN customer ON user_id = c_custkey WHERE event_type = 'click'""",
    "checked_commands": """
        SELECT c.*, reason IS NULL AS ok,
               CASE WHEN reason IS NULL THEN CAST(value AS DOUBLE) END AS temperature
        FROM (SELECT *, CASE WHEN value IS NULL THEN 'MISSING'
                 WHEN TRY_CAST(value AS DOUBLE) IS NULL OR isnan(TRY_CAST(value AS DOUBLE)) THEN 'NOT_A_NUMBER'
                 WHEN TRY_CAST(value AS DOUBLE) NOT BETWEEN -40 AND 100 THEN 'OUT_OF_RANGE' END AS reason
              FROM commands) c""",
    "checked_names": """
        SELECT *, reason IS NULL AS ok
        FROM (SELECT *, CASE WHEN name IS NULL OR trim(name) = '' THEN 'BLANK'
                             WHEN length(name) > 50 THEN 'TOO_LONG' END AS reason FROM commands) c""",
    "active": "SELECT * FROM devices WHERE is_active",
    "expired": """
        SELECT * FROM devices
        WHERE NOT is_active AND deactivated_at < TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 30 DAY""",
    "purges": f"""
        SELECT * FROM (SELECT CASE
                 WHEN id % 50 = 7 THEN 'not json'
                 WHEN id % 50 = 8 THEN '{{"deviceId":"' || device_id || '","action":"purge"}}'
                 WHEN id % 50 = 9 THEN '{{"deviceId":"dev-' || CAST(id AS VARCHAR) || '","action":"PURGE"}}'
                 WHEN NOT is_active AND deactivated_at < TIMESTAMP '2024-01-01 00:00:00'
                      THEN '{{"deviceId":"' || device_id || '","action":"PURGE"}}' END AS value,
               TIMESTAMP '2024-01-18 00:00:00' + to_days(CAST(id % 10 AS INTEGER)) AS purge_ts
        FROM devices) p WHERE value IS NOT NULL""",
    "purge_targets": """
        SELECT json_extract_string(value, '$.deviceId') AS device_id, purge_ts
        FROM purges WHERE json_valid(value) AND json_extract_string(value, '$.action') = 'PURGE'""",
    "latest_purges": """
        SELECT device_id, max(purge_ts) AS purge_ts FROM purge_targets
        WHERE regexp_full_match(device_id, '[0-9a-fA-F-]{36}') GROUP BY device_id""",
}

_NEEDS = {
    "fields": ["raw"],
    "parsed": ["fields"],
    "writes": ["points"],
    "dense_views": ["views"],
    "dense_points": ["points"],
    "faulty_views": ["views"],
    "routed": ["messages"],
    "decisions": ["access_requests", "devices"],
    "resolved": ["codes", "claims"],
    "gone_users": ["identity_events"],
    "checked_commands": ["commands"],
    "checked_names": ["commands"],
    "active": ["devices"],
    "expired": ["devices"],
    "purges": ["devices"],
    "purge_targets": ["purges"],
    "latest_purges": ["purge_targets"],
}


def over(names: str, query: str, recursive: str = "") -> str:
    """``query`` with the named inputs, and whatever they build on, defined ahead of it."""
    ordered: list[str] = []

    def need(name: str) -> None:
        for below in _NEEDS.get(name, []):
            need(below)
        if name not in ordered:
            ordered.append(name)

    for name in names.split():
        need(name)
    ctes = [f"{name} AS ({SQL[name]})" for name in ordered]
    if recursive:
        ctes.append(recursive)
    return f"WITH {'RECURSIVE ' if recursive else ''}{', '.join(ctes)} {query}"
