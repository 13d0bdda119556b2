"""SQL that gives the expected rows of the registered queries on the same tables."""

# The device messages, their normalised payloads, and the outcome of every check.
_BASE = r"""
src AS (
  SELECT event_id AS n, ts, user_id, event_type, value AS v,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS k
  FROM events
),
msg AS (
  SELECT n, k, v,
    'ingestion.raw' AS topic, CAST(n % 4 AS INTEGER) AS "partition", n AS "offset",
    CASE WHEN n % 97 = 0 THEN '' ELSE 'dev-' || user_id END AS device_id,
    CASE event_type WHEN 'click' THEN 'energy_meter' WHEN 'purchase' THEN 'financial_stream'
      WHEN 'view' THEN 'temperature_sensor' WHEN 'signup' THEN 'climate_sensor'
      WHEN 'error' THEN 'power_meter' END AS type,
    ts AS occurred_at, ts + to_seconds(n % 300) AS arrived_at,
    CASE WHEN event_type = 'click' THEN CASE WHEN k % 5 = 0 THEN -v WHEN k % 5 <> 1 THEN v * 10 END END AS r_power,
    CASE WHEN event_type = 'click' THEN v * 100 END AS r_energy,
    CASE WHEN event_type = 'click' THEN CAST(200 + k * 4 AS FLOAT) END AS r_voltage,
    CASE WHEN event_type = 'click' THEN CAST(k * 10 AS FLOAT) END AS r_current,
    CASE WHEN event_type = 'purchase' THEN round(v * 100) END AS r_amount,
    CASE WHEN event_type = 'purchase' THEN CASE WHEN k % 3 = 0 THEN ' usd ' ELSE 'EUR' END END AS r_currency,
    CASE WHEN event_type = 'purchase' THEN '  m' || k || ' ' END AS r_merchant,
    CASE WHEN event_type = 'purchase' THEN CASE k % 4 WHEN 0 THEN 'COMPLETED' WHEN 1 THEN ' pending'
      WHEN 2 THEN 'Failed' ELSE 'approved' END END AS r_status,
    CASE WHEN event_type IN ('view', 'signup') THEN v - 60 END AS r_temperature,
    CASE WHEN event_type IN ('view', 'signup') THEN v - 5 END AS r_humidity,
    CASE WHEN event_type IN ('view', 'signup') THEN v * 2 END AS r_aqi
  FROM src
),
decoded AS (
  SELECT *,
    CASE WHEN type = 'power_meter' THEN 'unknown' ELSE type END AS domain,
    CASE WHEN type = 'energy_meter' THEN coalesce(r_power, 0) END AS d_power,
    CASE WHEN type = 'temperature_sensor' THEN r_temperature END AS d_temperature,
    CASE WHEN type = 'temperature_sensor' THEN r_humidity END AS d_humidity,
    CASE WHEN type = 'temperature_sensor' THEN r_aqi END AS d_aqi
  FROM msg
),
norm AS (
  SELECT *,
    CASE type WHEN 'financial_stream' THEN 'device' WHEN 'energy_meter' THEN 'sensor'
      WHEN 'temperature_sensor' THEN 'sensor' WHEN 'power_meter' THEN 'unknown' END AS entity_type,
    CASE WHEN type = 'power_meter' THEN 'unknown' WHEN type <> 'climate_sensor' THEN type END AS source,
    (CASE WHEN type = 'energy_meter' THEN
      CASE WHEN greatest(d_power, 0) = 0 AND r_voltage > 0 AND r_current > 0
        THEN CAST(r_voltage AS DOUBLE) * CAST(r_current AS DOUBLE) / 1000
        ELSE greatest(d_power, 0) END END / 10) * 10 AS power_w,
    CASE WHEN r_energy IS NOT NULL THEN greatest(r_energy, 0) END AS energy_wh, r_voltage AS voltage_v, r_current AS current_ma,
    r_amount AS amount_minor, upper(trim(r_currency)) AS currency, trim(r_merchant) AS merchant,
    lower(trim(r_status)) AS status,
    CASE WHEN d_temperature IS NOT NULL THEN least(greatest(d_temperature, -50), 100) END AS temperature_c,
    CASE WHEN d_humidity IS NOT NULL THEN least(greatest(d_humidity, 0), 100) END AS humidity_percent,
    CASE WHEN d_aqi IS NOT NULL THEN least(greatest(d_aqi, 0), 500) END AS air_quality_index
  FROM decoded
),
ruled AS (
  SELECT *,
    CASE type
      WHEN 'energy_meter' THEN concat_ws(', ',
        CASE WHEN power_w = 0 THEN 'power_w:required' END,
        CASE WHEN energy_wh = 0 THEN 'energy_wh:required' END,
        CASE WHEN voltage_v = 0 THEN 'voltage_v:required' WHEN voltage_v > 500 THEN 'voltage_v:lte=500' END,
        CASE WHEN current_ma = 0 THEN 'current_ma:required' END)
      WHEN 'financial_stream' THEN concat_ws(', ',
        CASE WHEN amount_minor = 0 THEN 'amount_minor:required' END,
        CASE WHEN currency = '' THEN 'currency:required' END,
        CASE WHEN merchant = '' THEN 'merchant:required' END,
        CASE WHEN status = '' THEN 'status:required'
             WHEN status NOT IN ('completed', 'failed', 'pending') THEN 'status:oneof' END)
      WHEN 'temperature_sensor' THEN concat_ws(', ',
        CASE WHEN temperature_c = 0 THEN 'temperature_c:required' END,
        CASE WHEN humidity_percent = 0 THEN 'humidity_percent:required' END,
        CASE WHEN air_quality_index = 0 THEN 'air_quality_index:required' END)
      ELSE '' END AS violations
  FROM norm
),
cls AS (
  SELECT *,
    regexp_replace(md5(topic || '|' || "partition" || '|' || "offset"),
      '(.{8})(.{4})(.{4})(.{4})(.{12})', '\1-\2-\3-\4-\5') AS event_id,
    CASE WHEN device_id = '' THEN 'missing required field DeviceId'
         WHEN domain = 'unknown' THEN 'unsupported_domain'
         WHEN type = 'climate_sensor' THEN 'unknown_data_type'
         WHEN violations <> '' THEN 'payload_rules' END AS failed_check,
    CASE WHEN device_id = '' THEN 'process'
         WHEN domain = 'unknown' OR type = 'climate_sensor' OR violations <> '' THEN 'transform' END AS stage
  FROM ruled
),
silver AS (
  SELECT event_id, domain, type AS event_type, device_id AS entity_id, entity_type, occurred_at,
    arrived_at AS ingested_at, source, '1.0.0' AS schema_version, CAST(NULL AS VARCHAR) AS metadata,
    topic, "partition", "offset", power_w, energy_wh, voltage_v, current_ma, amount_minor, currency,
    merchant, status, temperature_c, humidity_percent, air_quality_index
  FROM cls WHERE stage IS NULL
),
failed AS (
  SELECT
    regexp_replace(md5('load-1|' || topic || '|' || "partition" || '|' || "offset" || '|' || stage),
      '(.{8})(.{4})(.{4})(.{4})(.{12})', '\1-\2-\3-\4-\5') AS id,
    stage,
    CASE failed_check
      WHEN 'missing required field DeviceId' THEN 'field ''msg'': expected DeviceMessage, got DeviceMessage, because of failed to validate message; detailed error: ' || chr(10) || ' missing required field DeviceId'
      WHEN 'unsupported_domain' THEN 'field ''domain'': expected DataTypes, got DataTypes, because of failed to validate data; detailed error: ' || chr(10) || ' unsupported domain: unknown (supported: [temperature_sensor climate_sensor ev_charger grid_meter motion_sensor financial_stream energy_meter solar_panel battery])'
      WHEN 'unknown_data_type' THEN 'unknown data type'
      ELSE CASE type
        WHEN 'energy_meter' THEN 'field ''er'': expected EnergyReading, got EnergyReading'
        WHEN 'financial_stream' THEN 'field ''ft'': expected FinancialTransaction, got FinancialTransaction'
        ELSE 'field ''e'': expected EnvironmentalSensor, got EnvironmentalSensor' END
        || ', because of failed to validate data; detailed error: ' || chr(10) || ' broken rules: ' || violations
    END AS error,
    CASE WHEN stage = 'process' THEN 'validating_message' ELSE 'validating_data' END AS error_type,
    CASE WHEN stage = 'process' THEN 'failed to validate message'
         WHEN failed_check = 'unknown_data_type' THEN 'unknown data type'
         ELSE 'failed to validate data' END AS reason,
    date_trunc('second', arrived_at) AS created_at, CAST(arrived_at AS DATE) AS created_date,
    topic, "partition", "offset", 'load-1' AS batch_id, device_id, type, occurred_at, r_temperature, r_humidity
  FROM cls WHERE stage IS NOT NULL
),
ord AS (
  SELECT 'ingestion.orders' AS topic, CAST(o_orderkey % 4 AS INTEGER) AS "partition", o_orderkey AS "offset",
    regexp_replace(md5('ingestion.orders|' || (o_orderkey % 4) || '|' || o_orderkey),
      '(.{8})(.{4})(.{4})(.{4})(.{12})', '\1-\2-\3-\4-\5') AS event_id,
    'cust-' || o_custkey AS entity_id, o_orderdate AS ordered_at, round(o_totalprice * 100) AS amount_minor,
    'USD' AS currency, o_orderpriority AS merchant,
    CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'pending' ELSE 'failed' END AS status
  FROM orders
)
"""

_PAYLOAD = (
    "power_w, energy_wh, voltage_v, current_ma, amount_minor, currency, merchant, status, "
    "temperature_c, humidity_percent, air_quality_index"
)
_EVENT = (
    "event_id, domain, event_type, entity_id, entity_type, occurred_at, ingested_at, source, "
    f'schema_version, metadata, topic, "partition", "offset", {_PAYLOAD}'
)
_RFC3339 = "replace(CAST({} AS VARCHAR), ' ', 'T') || 'Z'"
_NEWEST = "ORDER BY ingested_at DESC, event_id DESC"


def _sql(select: str, *extra: str) -> str:
    return "WITH " + ",\n".join([_BASE.strip(), *extra]) + "\n" + select


# Throughput by window of the given number of seconds.
def _series(seconds: int = 3600) -> str:
    bucket = f"make_timestamp(CAST(floor(epoch(moment) / {seconds}) AS BIGINT) * {seconds} * 1000000)"
    return f"""series AS (
  SELECT topic, window_start, count(*) AS sent, CAST(sum(stored) AS BIGINT) AS processed,
    round(sum(stored) / count(*) * 100, 2) AS success_rate, round(sum(stored) / {seconds}, 1) AS throughput
  FROM (SELECT topic, {bucket} AS window_start, stored FROM (
    SELECT topic, ingested_at AS moment, 1 AS stored FROM silver
    UNION ALL SELECT topic, created_at, 0 FROM failed))
  GROUP BY topic, window_start)"""


# Refused messages have both ends of their latency to the second, and no domain before the store.
_TIMED = """timed AS (
  SELECT 'success' AS status, domain, epoch(ingested_at - occurred_at) AS s FROM silver
  UNION ALL SELECT 'error', NULL, epoch(created_at - date_trunc('second', occurred_at)) FROM failed
  WHERE stage <> 'process')"""

_BACKLOG = """backlog AS (
  SELECT topic, minute, CAST(sum(change) OVER (PARTITION BY topic ORDER BY minute) AS BIGINT) AS backlog
  FROM (SELECT topic, minute, sum(step) AS change FROM (
      SELECT topic, date_trunc('minute', occurred_at) AS minute, 1 AS step FROM silver
      UNION ALL SELECT topic, date_trunc('minute', ingested_at), -1 FROM silver)
    GROUP BY topic, minute))"""

_STATS = """stats AS (
  SELECT topic, max(backlog) AS peak, CAST(floor(sum(backlog) / count(*)) AS BIGINT) AS average,
    arg_max(backlog, minute) AS final FROM backlog GROUP BY topic)"""

_FRESH = """fresh AS (
  SELECT source, last_ingested_at, CAST(floor(epoch(as_of - last_ingested_at)) AS BIGINT) AS age_seconds,
    floor(epoch(as_of - last_ingested_at)) > 120 AS is_stale
  FROM (SELECT source, max(ingested_at) AS last_ingested_at FROM silver GROUP BY source),
       (SELECT max(ingested_at) AS as_of FROM silver))"""

# Spoiled records by slot: 0..6 and 8 do not decode, 7 decodes to an empty message.
_SPOILED = """spoiled AS (
  SELECT *, (n % 16 IN (0, 1, 2, 3, 4, 5, 6, 8)) AS is_malformed, n % 16 = 7 AS is_empty FROM cls)"""

_ODD = """odd AS (
  SELECT "offset",
    CASE WHEN n10 = 0 THEN '00000000-0000-0000-0000-000000000000' ELSE event_id END AS event_id,
    CASE WHEN n10 = 8 THEN chr(12288) || 'Energy_METER ' ELSE domain END AS domain,
    CASE WHEN n10 = 7 THEN '  Energy Meter' || chr(9) ELSE event_type END AS event_type,
    CASE WHEN n10 = 1 THEN repeat('x', 256) WHEN n10 = 2 THEN repeat('é', 255) ELSE entity_id END AS entity_id,
    CASE WHEN n10 = 9 THEN ' Sensor' || chr(10) ELSE entity_type END AS entity_type,
    CASE WHEN n10 = 6 THEN '' ELSE source END AS source,
    CASE n10 WHEN 3 THEN '1.0' WHEN 4 THEN '2.1.0-rc.1+b5' WHEN 5 THEN '' ELSE schema_version END AS schema_version,
    "offset" % 7 = 0 AS spoiled, n10 <> 7 AS typed, event_type AS true_type, status, voltage_v, humidity_percent
  FROM (SELECT *, "offset" % 10 AS n10 FROM silver))"""

_TOKEN = (
    "rtrim(translate(to_base64(encode('{\"t\":\"' || "
    + _RFC3339.format("ingested_at")
    + " || '\",\"id\":\"' || event_id || '\"}')), '+/', '-_'), '=')"
)

# All rows of the second load that are refused: everything stored before, and each order's copy.
_CONFLICTS = """refused AS (
  SELECT topic, "partition", "offset", event_id, ingested_at, domain, event_type, entity_type, source FROM silver
  UNION ALL
  SELECT topic, "partition", "offset", event_id, ordered_at, 'financial_stream', 'financial_stream', 'device', 'financial_stream' FROM ord)"""


def _violations(domain: str) -> str:
    return _sql(f"SELECT \"offset\", violations FROM ruled WHERE domain = '{domain}'")


ORACLES: dict[str, str] = {
    # sources and sinks
    "src_stream": _sql('SELECT topic, "partition", "offset", arrived_at, device_id, type, occurred_at FROM cls'),
    "src_fanin": _sql(
        "SELECT topic, domain, stage, count(*) AS n FROM (SELECT topic, domain, stage FROM cls "
        "UNION ALL SELECT topic, 'financial_stream', NULL FROM ord) GROUP BY topic, domain, stage"
    ),
    "src_replay_documents": _sql(
        "SELECT device_id, type, occurred_at, stage, failed_check FROM cls "
        "QUALIFY row_number() OVER (PARTITION BY device_id ORDER BY n DESC) = 1"
    ),
    "src_replay": _sql("SELECT device_id, type, occurred_at, stage, failed_check FROM cls"),
    "scan_events": _sql(f"SELECT {_EVENT} FROM silver"),
    "failed_sample": _sql("SELECT stage, error FROM failed ORDER BY created_at DESC, id DESC LIMIT 5"),
    "store_events": _sql(
        "SELECT event_id, 'financial_stream' AS domain, 'financial_stream' AS event_type, entity_id, "
        "'device' AS entity_type, ordered_at AS occurred_at, ordered_at AS ingested_at, 'financial_stream' AS source, "
        "'1.0.0' AS schema_version, CAST(NULL AS VARCHAR) AS metadata, topic, \"partition\", \"offset\", "
        "CAST(NULL AS DOUBLE) AS power_w, CAST(NULL AS DOUBLE) AS energy_wh, CAST(NULL AS FLOAT) AS voltage_v, "
        "CAST(NULL AS FLOAT) AS current_ma, amount_minor, currency, merchant, status, "
        "CAST(NULL AS DOUBLE) AS temperature_c, CAST(NULL AS DOUBLE) AS humidity_percent, "
        "CAST(NULL AS DOUBLE) AS air_quality_index FROM ord"
    ),
    "store_conflicts": _sql(
        "SELECT regexp_replace(md5('load-2|' || topic || '|' || \"partition\" || '|' || \"offset\" || '|store'), "
        r"'(.{8})(.{4})(.{4})(.{4})(.{12})', '\1-\2-\3-\4-\5') AS id, 'store' AS stage, "
        "'field ''msg'': expected DeviceMessage, got DeviceMessage, because of failed to store message; "
        "detailed error: ' || chr(10) || ' event_id ' || event_id || ' is stored already' AS error, "
        "'storing_message' AS error_type, 'failed to store message' AS reason, "
        "date_trunc('second', ingested_at) AS created_at, topic, \"partition\", \"offset\" FROM refused",
        _CONFLICTS,
    ),
    "dedupe_batch": _sql(
        'SELECT event_id, domain, entity_id, ingested_at, topic, "offset" FROM silver UNION ALL '
        "SELECT event_id, 'financial_stream', entity_id, ordered_at, topic, \"offset\" FROM ord"
    ),
    "quarantine": _sql(
        'SELECT id, stage, error, error_type, reason, created_at, created_date, topic, "partition", "offset", batch_id FROM failed'
    ),
    "dlq_records": _sql(
        "SELECT stage AS key, stage, error, CASE WHEN stage <> 'process' THEN device_id END AS device_id, "
        "CASE WHEN stage <> 'process' THEN type END AS type, "
        f"CASE WHEN stage <> 'process' THEN {_RFC3339.format('occurred_at')} END AS message_time, "
        "CASE WHEN stage <> 'process' THEN r_temperature END AS temperature_c, "
        "stage <> 'process' AS has_message FROM failed"
    ),
    "fallback_sink": _sql(
        "SELECT 'table' AS sink, stage, count(*) AS n FROM failed GROUP BY stage "
        "UNION ALL SELECT 'dead letters', stage, count(*) FROM (SELECT stage FROM failed "
        "UNION ALL SELECT 'store' FROM silver UNION ALL SELECT 'process' FROM ord) GROUP BY stage"
    ),
    "payload_json": _sql(
        "SELECT event_id, domain, power_w, energy_wh, amount_minor, temperature_c, currency, merchant, status, "
        "CASE WHEN domain = 'unknown' THEN k END AS k FROM cls "
        "WHERE stage IS NULL OR failed_check = 'unsupported_domain'"
    ),
    "create_tables": _sql(
        "SELECT 'events' AS name, domain AS label, count(*) AS n FROM silver GROUP BY domain "
        "UNION ALL SELECT 'failed_messages', stage, count(*) FROM failed GROUP BY stage"
    ),
    # filters and predicates
    "malformed": _sql('SELECT topic, "offset", is_malformed FROM spoiled', _SPOILED),
    "raw_validation": _sql(
        "SELECT \"offset\", CASE WHEN is_empty OR device_id = '' THEN 'missing required field DeviceId' END AS raw_error "
        "FROM spoiled WHERE NOT is_malformed",
        _SPOILED,
    ),
    "domain_allowlist": _sql(
        "SELECT domain, count(*) FILTER (domain <> 'unknown') AS by_default, "
        "count(*) FILTER (domain = 'energy_meter') AS energy_only, count(*) AS \"empty\" FROM cls GROUP BY domain"
    ),
    "valid_types": _sql("SELECT type, type <> 'power_meter' AS is_valid, count(*) AS n FROM cls GROUP BY type"),
    "unregistered_types": _sql("SELECT domain, count(*) AS n FROM cls WHERE domain = 'climate_sensor' GROUP BY domain"),
    "validate_energy": _violations("energy_meter"),
    "validate_finance": _violations("financial_stream"),
    "validate_environment": _violations("temperature_sensor"),
    "validate_unknown": _violations("unknown"),
    "validate_envelope": _sql(
        "SELECT \"offset\", concat_ws(', ', "
        "CASE WHEN event_id = '00000000-0000-0000-0000-000000000000' THEN 'event_id:required' END, "
        "CASE WHEN length(entity_id) > 255 THEN 'entity_id:max=255' END, "
        "CASE WHEN source = '' THEN 'source:required' END, "
        "CASE WHEN schema_version = '' THEN 'schema_version:required' "
        "WHEN schema_version = '1.0' THEN 'schema_version:semver' END, "
        "CASE WHEN spoiled AND typed THEN CASE true_type WHEN 'financial_stream' THEN 'status:oneof' "
        "WHEN 'energy_meter' THEN 'voltage_v:lte=500' WHEN 'temperature_sensor' THEN 'humidity_percent:gte=0' END END"
        ") AS violations FROM odd",
        _ODD,
    ),
    "get_event": _sql(f"SELECT {_EVENT} FROM silver {_NEWEST} LIMIT 1"),
    "list_after_cursor": _sql(f"SELECT {_EVENT} FROM silver {_NEWEST} LIMIT 20 OFFSET 50"),
    "delete_event": _sql(
        f"SELECT event_id, domain, ingested_at FROM silver WHERE event_id NOT IN "
        f"(SELECT event_id FROM silver {_NEWEST} LIMIT 100)"
    ),
    "read_integrity": _sql(
        "SELECT \"offset\", CASE \"offset\" % 8 WHEN 0 THEN 'payload cannot be decoded' "
        "WHEN 1 THEN 'payload cannot be decoded' WHEN 2 THEN 'invalid event UUID' "
        "WHEN 3 THEN CASE WHEN domain = 'financial_stream' THEN 'payload cannot be decoded' END "
        "WHEN 4 THEN 'payload cannot be decoded' END AS read_error FROM silver"
    ),
    # projections
    "decode_envelope": _sql(
        'SELECT topic, "partition", "offset", arrived_at, device_id, type, '
        f"{_RFC3339.format('occurred_at')} AS message_time, occurred_at FROM cls"
    ),
    "headers_map": _sql("SELECT \"offset\", 2 AS n, 'retry' AS trace, CAST(\"partition\" AS VARCHAR) AS zone FROM cls"),
    "decode_payload": _sql(
        "SELECT \"offset\", false AS is_misfit, d_power AS power_w, r_energy AS energy_wh, r_voltage AS voltage_v, "
        "r_current AS current_ma, r_amount AS amount_minor, r_currency AS currency, r_merchant AS merchant, "
        "r_status AS status, d_temperature AS temperature_c, d_humidity AS humidity_percent, "
        "d_aqi AS air_quality_index FROM cls"
    ),
    "normalize_energy": _sql(
        "SELECT \"offset\", power_w, energy_wh, voltage_v, current_ma FROM cls WHERE domain = 'energy_meter'"
    ),
    "normalize_finance": _sql(
        "SELECT \"offset\", amount_minor, currency, merchant, status FROM cls WHERE domain = 'financial_stream'"
    ),
    "normalize_environment": _sql(
        "SELECT \"offset\", temperature_c, humidity_percent, air_quality_index FROM cls WHERE domain = 'temperature_sensor'"
    ),
    "normalize_unknown": _sql(
        "SELECT \"offset\", '{\"k\":' || k || '}' AS data FROM cls WHERE domain = 'unknown'"
    ),
    "transform": _sql(
        "SELECT event_id, domain, type AS event_type, device_id AS entity_id, entity_type, source, occurred_at, "
        f"arrived_at AS ingested_at, stage, failed_check, {_PAYLOAD} FROM cls"
    ),
    "normalize_envelope": _sql(
        "SELECT \"offset\", CASE WHEN domain LIKE '%METER%' THEN 'energy_meter' ELSE domain END AS domain, "
        "CASE WHEN event_type LIKE '%Meter%' THEN 'energy_meter' ELSE event_type END AS event_type, "
        "CASE WHEN entity_type LIKE '%Sensor%' THEN 'sensor' ELSE entity_type END AS entity_type, "
        "CASE WHEN source = '' THEN 'unknown' ELSE source END AS source, "
        "CASE WHEN schema_version = '' THEN '1.0' ELSE schema_version END AS schema_version, "
        "CASE WHEN spoiled AND status IS NOT NULL THEN CASE WHEN typed THEN 'approved' ELSE ' Approved ' END ELSE status END AS status, "
        "CAST(CASE WHEN spoiled AND voltage_v IS NOT NULL THEN 900 ELSE voltage_v END AS DOUBLE) AS voltage_v, "
        "CASE WHEN spoiled AND humidity_percent IS NOT NULL THEN CASE WHEN typed THEN 0.0 ELSE -5.0 END ELSE humidity_percent END "
        "AS humidity_percent FROM odd",
        _ODD,
    ),
    "enrich_registry": _sql('SELECT "offset", domain, entity_type, source FROM cls'),
    "response_projection": _sql(
        f"SELECT event_id, domain, event_type, entity_id, occurred_at, source, schema_version, {_PAYLOAD} FROM silver"
    ),
    "typed_readback": _sql(f"SELECT event_id, {_PAYLOAD} FROM silver"),
    "failure_rows": _sql(
        "SELECT id, stage, error, error_type, reason, created_at, "
        "CASE WHEN stage <> 'process' THEN device_id END AS device_id, "
        "CASE WHEN stage <> 'process' THEN type END AS type, "
        f"CASE WHEN stage <> 'process' THEN {_RFC3339.format('occurred_at')} END AS message_time, "
        "CASE WHEN stage <> 'process' THEN r_humidity END AS humidity_percent, "
        "stage = 'process' AS is_empty, type AS raw_type FROM failed"
    ),
    "safe_message_view": _sql('SELECT device_id, type, occurred_at AS "timestamp" FROM cls'),
    "safe_event_view": _sql("SELECT event_id, domain, event_type, entity_type, schema_version FROM silver"),
    "safe_finance_view": _sql(
        "SELECT event_id, currency, status, CAST(CAST(amount_minor AS BIGINT) AS VARCHAR) AS amount "
        "FROM silver WHERE domain = 'financial_stream'"
    ),
    "redact_keys": _sql(
        "SELECT \"offset\", '[REDACTED]' AS hidden_token, type, '[REDACTED]' AS secret, '[REDACTED]' AS password, "
        "topic, '[REDACTED]' AS auth, CAST(\"partition\" AS VARCHAR) AS zone FROM cls"
    ),
    "truncate_bytes": (
        "SELECT doc_id, CASE WHEN strlen(text) <= 512 THEN text ELSE "
        "left(text, list_max([i for i in range(0, 513) if strlen(left(text, i)) <= 512])) || '…[truncated]' "
        "END AS text FROM documents"
    ),
    # aggregations
    "table_stats": _sql(
        "SELECT (SELECT count(*) FROM silver) AS total_events, (SELECT count(*) FROM failed) AS failed_messages"
    ),
    "failed_by_stage": _sql("SELECT stage, count(*) AS n FROM failed GROUP BY stage"),
    "metric_process": _sql(
        "SELECT 'process_data' AS operation, CASE WHEN stage = 'process' THEN 'error' ELSE 'success' END AS status, "
        "count(*) AS total FROM cls GROUP BY ALL"
    ),
    "metric_poll": _sql(
        "SELECT 'poll_message' AS operation, CASE WHEN is_malformed THEN 'error' ELSE 'success' END AS status, "
        "CASE WHEN is_empty THEN '' WHEN NOT is_malformed THEN type END AS device_type, count(*) AS total "
        "FROM spoiled GROUP BY ALL",
        _SPOILED,
    ),
    "metric_transform": _sql(
        "SELECT CASE WHEN stage IS NULL THEN 'success' ELSE 'error' END AS status, "
        "CASE WHEN stage IS NULL THEN domain END AS domain, CASE WHEN stage IS NULL THEN type END AS event_type, "
        "CASE WHEN stage IS NOT NULL THEN type END AS device_type, count(*) AS total "
        "FROM cls WHERE stage IS DISTINCT FROM 'process' GROUP BY ALL"
    ),
    "metric_transform_errors": _sql(
        "SELECT type AS device_type, device_id, count(*) AS errors FROM cls WHERE stage = 'transform' GROUP BY ALL"
    ),
    "metric_store": _sql(
        "SELECT domain, event_type, entity_type, source, 'error' AS status, count(*) AS total FROM refused GROUP BY ALL "
        "UNION ALL SELECT 'financial_stream', 'financial_stream', 'device', 'financial_stream', 'success', count(*) "
        "FROM ord HAVING count(*) > 0",
        _CONFLICTS,
    ),
    "latency_histogram": _sql(
        "SELECT status, domain, CASE "
        + " ".join(f"WHEN s <= {b} THEN '{b}'" for b in (0, 5, 10, 25, 50, 75, 100, 250, 500, 750, 1000, 2500, 5000, 7500, 10000))
        + " ELSE '+Inf' END AS le, count(*) AS n FROM "
        "timed GROUP BY ALL",
        _TIMED,
    ),
    "latency_percentiles": _sql(
        "SELECT status, domain, quantile_disc(s, 0.5) AS p50, quantile_disc(s, 0.95) AS p95, quantile_disc(s, 0.99) AS p99 "
        "FROM timed GROUP BY ALL",
        _TIMED,
    ),
    "throughput_by_window": _sql("SELECT * FROM series", _series()),
    "throughput_stream": _sql("SELECT * FROM series", _series()),
    "throughput_tier": _sql(
        "SELECT topic, throughput, CASE WHEN throughput >= 100 THEN 'Excellent' WHEN throughput >= 50 THEN 'Good' "
        "WHEN throughput >= 25 THEN 'Moderate' ELSE 'Poor' END AS tier, count(*) AS n FROM series GROUP BY ALL",
        _series(1),
    ),
    "throughput_trend": _sql("SELECT * FROM series ORDER BY window_start DESC, topic LIMIT 10", _series()),
    "backlog_stats": _sql("SELECT * FROM stats", _BACKLOG, _STATS),
    "quality_alerts": _sql(
        "SELECT topic, load, alert FROM (SELECT s.*, r.success_rate, l.load FROM stats s "
        "JOIN (SELECT topic, round(sum(processed) / sum(sent) * 100, 2) AS success_rate FROM series GROUP BY topic) r USING (topic), "
        "(VALUES ('low'), ('medium'), ('high')) l(load)) x, "
        "LATERAL (SELECT unnest([CASE WHEN load = 'low' AND peak > 100 THEN 'peak_backlog_over_100' END, "
        "CASE WHEN load = 'low' AND success_rate <> 100 THEN 'success_below_100_percent' END, "
        "CASE WHEN load = 'medium' AND peak > 1000 THEN 'peak_backlog_over_1000' END, "
        "CASE WHEN load = 'medium' AND average > 500 THEN 'average_backlog_over_500' END, "
        "CASE WHEN load = 'high' AND peak > 10000 THEN 'peak_backlog_over_10000' END, "
        "CASE WHEN load = 'high' AND final > 1000 THEN 'final_backlog_over_1000' END]) AS alert) WHERE alert IS NOT NULL",
        _BACKLOG, _STATS, _series(),
    ),
    "error_lines": (
        "SELECT source, count(*) FILTER (regexp_matches(line, '(?i)error|failed|panic')) AS error_lines "
        "FROM (SELECT source, unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY source"
    ),
    "freshness": _sql("SELECT * FROM fresh", _FRESH),
    "health_rollup": _sql(
        "SELECT CASE WHEN bool_or(is_stale) THEN 'unhealthy' ELSE 'healthy' END AS status, "
        "'{' || string_agg('\"' || source || '\":\"' || CASE WHEN is_stale THEN 'last event ' || age_seconds || "
        "' seconds ago' ELSE 'ok' END || '\"', ',' ORDER BY source) || '}' AS checks FROM fresh",
        _FRESH,
    ),
    # windows
    "regression_vs_previous": _sql(
        "SELECT topic, window_start, processed, previous, "
        "CASE WHEN previous <> 0 THEN change END AS change_percent, "
        "CASE WHEN previous IS NULL OR previous = 0 THEN 'first run' WHEN change < -10 THEN 'regression' "
        "WHEN change > 10 THEN 'improvement' ELSE 'stable' END AS verdict FROM ("
        "SELECT *, round((processed - previous) / previous * 100, 1) AS change FROM ("
        "SELECT topic, window_start, processed, lag(processed) OVER (PARTITION BY topic ORDER BY window_start) AS previous "
        "FROM series))",
        _series(),
    ),
    "page_numbers": _sql(
        "SELECT event_id, ingested_at, position, CAST(floor(position / 20) AS BIGINT) AS page FROM ("
        f"SELECT event_id, ingested_at, row_number() OVER ({_NEWEST}) - 1 AS position FROM silver)"
    ),
    "backlog_series": _sql("SELECT * FROM backlog", _BACKLOG),
    # top-k reads
    "list_first_page": _sql(f"SELECT {_EVENT} FROM silver {_NEWEST} LIMIT 50"),
    "list_page": _sql(
        f"SELECT event_id, ingested_at, (SELECT count(*) > 40 FROM silver) AS has_more, "
        f"CASE WHEN (SELECT count(*) > 40 FROM silver) THEN (SELECT {_TOKEN} FROM silver {_NEWEST} LIMIT 1 OFFSET 39) END "
        f"AS next_cursor FROM silver {_NEWEST} LIMIT 20 OFFSET 20"
    ),
    "events_by_domain": _sql(
        f"SELECT {_EVENT} FROM silver WHERE domain = 'energy_meter' ORDER BY occurred_at DESC, event_id DESC LIMIT 25"
    ),
    "events_by_source": _sql(f"SELECT {_EVENT} FROM silver WHERE source = 'financial_stream' {_NEWEST} LIMIT 25"),
    "latest_20": _sql(f"SELECT {_EVENT} FROM silver {_NEWEST} LIMIT 20"),
    # sets
    "history_union": _sql(
        "SELECT * FROM series UNION ALL SELECT topic, date_trunc('hour', CAST(ordered_at AS TIMESTAMP)), count(*), "
        "count(*), 100.0, round(count(*) / 3600, 1) FROM ord GROUP BY ALL",
        _series(),
    ),
    "split_is_partition": _sql(
        "SELECT 1 AS in_rows, CASE WHEN good THEN 1 ELSE 0 END AS accepted_rows, CASE WHEN good THEN 0 ELSE 1 END AS rejected_rows, "
        "count(*) AS n FROM (SELECT NOT is_malformed AND NOT is_empty AND stage IS NULL AS good FROM spoiled) GROUP BY ALL",
        _SPOILED,
    ),
    # scalar functions
    "trim_space": _sql(
        "SELECT \"offset\" AS id, trim(type || ' x ' || device_id) AS text FROM cls UNION ALL "
        "SELECT doc_id, md5(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) FROM documents"
    ),
    "to_utc": "SELECT event_id, ts AS utc FROM events",
    "parse_type": _sql(
        "SELECT \"offset\", CASE WHEN \"offset\" % 3 = 2 THEN domain ELSE 'unknown' END AS domain FROM cls"
    ),
    "clamp_limit": (
        "SELECT event_id, CASE WHEN event_id % 211 - 40 <= 0 THEN 20 ELSE least(event_id % 211 - 40, 100) END AS page_size FROM events"
    ),
    "parse_int": "SELECT event_id, CASE WHEN event_id % 6 IN (0, 5) AND event_id > 0 THEN event_id ELSE 20 END AS page_size FROM events",
    "cursor_encode": _sql(f"SELECT event_id, {_TOKEN} AS token FROM silver"),
    "cursor_decode": _sql(
        'SELECT "offset", CASE WHEN "offset" % 3 <> 0 THEN ingested_at END AS ingested_at, '
        'CASE WHEN "offset" % 3 <> 0 THEN event_id END AS event_id FROM silver'
    ),
    "parse_rfc3339": (
        "SELECT event_id, CASE event_id % 10 WHEN 0 THEN ts "
        "WHEN 1 THEN date_trunc('second', ts) + to_microseconds(123456) "
        "WHEN 2 THEN date_trunc('second', ts) + to_minutes(23 * 60 + 30) "
        "WHEN 3 THEN date_trunc('second', ts) - to_hours(14) END AS \"at\" FROM events"
    ),
    "event_id": _sql(
        'SELECT topic, "partition", "offset", event_id FROM cls UNION ALL SELECT topic, "partition", "offset", event_id FROM ord'
    ),
    # streaming
    "stream_ingest": _sql(
        'SELECT topic, "partition", "offset", stage, CASE WHEN stage IS NULL THEN event_id END AS event_id FROM cls'
    ),
    "stream_metrics": _sql("SELECT count(*) AS messages, count(*) AS input_rows FROM cls"),
    "stream_counters": _sql(
        "SELECT stage, domain, type AS event_type, CAST(sum(CASE WHEN stage IS NULL THEN 1 ELSE 2 END) AS BIGINT) AS n "
        "FROM cls GROUP BY ALL "
        "UNION ALL SELECT 'store', domain, type, count(*) FROM cls WHERE stage IS NULL GROUP BY ALL"
    ),
    # extension
    "custom_domain": _sql(
        "SELECT event_id, domain, 'sensor' AS entity_type, 'building' AS source, r_temperature AS temperature_c, "
        "least(greatest(r_humidity, 0), 100) AS humidity_percent FROM cls WHERE type = 'climate_sensor' "
        "AND device_id <> '' AND r_temperature >= -55 AND greatest(r_humidity, 0) <> 0"
    ),
}
