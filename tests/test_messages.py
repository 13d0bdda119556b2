"""Every message rule, one row each."""

import json

import pytest
from helpers import climate, energy, finance, message, records
from pyspark.sql import functions as F

from telemill.domains import ENERGY, DuplicateDomain, default_registry
from telemill.operators.decode import decode, header_map
from telemill.operators.quarantine import dlq_records, failure_rows
from telemill.operators.transform import TransformConfig, classify, to_events, typed_payloads

GOLDEN = [
    (finance(), None),
    (climate(), None),
    (energy(), None),
    (climate(type_name="climate_sensor"), "transform"),
    (message("ev_charger", {"power_w": 6200}), "transform"),
    (message("power_meter", {"energy_import_kwh": 1720.0}), "transform"),
    (energy(-999, 0, 0, 0), "transform"),
    (message("energy_meter", {"power_w": 120.5}, device=""), "process"),
]

CASES = {
    "derive power": (energy(0, 500, 240, 500), None),
    "power missing": (message("energy_meter", {"energy_wh": 5, "voltage_v": 240, "current_ma": 500}), None),
    "null field": (message("energy_meter", {"power_w": None, "energy_wh": 5, "voltage_v": 2, "current_ma": 5}), None),
    "negatives": (energy(-50, -200, -10, -300), "payload_rules"),
    "voltage above limit": (energy(voltage=501), "payload_rules"),
    "voltage at limit": (energy(voltage=500), None),
    "finance case and blanks": (finance(9999, " eur ", "  Globex  ", "PENDING"), None),
    "bad status": (finance(status="approved"), "payload_rules"),
    "negative amount": (finance(-5), None),
    "zero amount": (finance(0), "payload_rules"),
    "blank merchant": (finance(merchant="   "), "payload_rules"),
    "zero temperature": (climate(0, 50, 10), "payload_rules"),
    "clamped": (climate(150, 120, 900), None),
    "humidity typo": (message("temperature_sensor", {"temperature_c": 22.5, "humidity": 45.2}), "payload_rules"),
    "empty metrics": (message("energy_meter", {}), "payload_rules"),
    "empty finance": (message("financial_stream", {}), "payload_rules"),
    "no metrics": (message("energy_meter"), "metrics_missing"),
    "null metrics": ('{"device_id":"d","type":"energy_meter","timestamp":"2024-01-05T14:35:22Z","metrics":null}', "metrics_missing"),
    "text for number": (energy("abc"), "payload_type"),
    "digits as text": (energy("5"), "payload_type"),
    "NaN as text": (energy("NaN"), "payload_type"),
    "true for number": (energy(True), "payload_type"),
    "object for number": (energy({"a": 1}), "payload_type"),
    "number for text": (finance(currency=5), "payload_type"),
    "float overflow": (energy(voltage=1e39), "payload_type"),
    "no device": (message("energy_meter", {}, device=None), "missing required field DeviceId"),
    "no type": (message(None, {}), "missing field Type"),
    "no time": (message("energy_meter", {}, time=None), "missing field Timestamp"),
    "zero time": (message("energy_meter", {}, time="0001-01-01T00:00:00Z"), "missing field Timestamp"),
    "nothing at all": ("{}", "missing required field DeviceId"),
    "null message": ("null", "missing required field DeviceId"),
    "blank device is a device": (message("financial_stream", {}, device=" "), "payload_rules"),
    "unknown literal": (message("unknown", {}), "unsupported_domain"),
    "type is case-sensitive": (message("Energy_Meter", {}), "unsupported_domain"),
    "truncated": (energy()[:30], "malformed"),
    "trailing text": (energy() + " junk", "malformed"),
    "trailing bracket": (energy() + "]", "malformed"),
    "two values": (energy() + "," + energy(), "malformed"),
    "array": ("[1,2]", "malformed"),
    "array of messages": ("[" + energy() + "]", "malformed"),
    "number": ("5", "malformed"),
    "empty": ("", "malformed"),
    "blank": ("  ", "malformed"),
    "absent value": (None, "malformed"),
    "single quotes": ("{'device_id':'d'}", "malformed"),
    "NaN": ('{"device_id":"d","metrics":{"power_w":NaN}}', "malformed"),
    "numeric device": ('{"device_id":5,"type":"energy_meter"}', "malformed"),
    "numeric type": ('{"device_id":"d","type":5}', "malformed"),
    "numeric time": ('{"device_id":"d","type":"energy_meter","timestamp":5}', "malformed"),
    "metrics array": (message("energy_meter", [1]), "malformed"),
    "metrics text": (message("energy_meter", '{"power_w":1}'), "malformed"),
    "bad time": (message("energy_meter", {}, time="nope"), "malformed"),
    "date only": (message("energy_meter", {}, time="2024-01-05"), "malformed"),
    "empty time": (message("energy_meter", {}, time=""), "malformed"),
    "surrounding blanks": (" \n" + energy() + "\t\n", None),
    "extra keys": (message("energy_meter", {"power_w": 1, "energy_wh": 1, "voltage_v": 1, "current_ma": 1, "x": {"y": [1]}}, zone={"a": 1}), None),
    "offset time": (message("energy_meter", {"power_w": 1, "energy_wh": 1, "voltage_v": 1, "current_ma": 1}, time="2024-01-05T23:35:22.5+09:00"), None),
}


def test_golden_messages(spark):
    texts = [t for t, _ in GOLDEN]
    found = classify(decode(records(spark, texts))).select("offset", "stage").collect()
    assert {r["offset"]: r["stage"] for r in found} == dict(enumerate(s for _, s in GOLDEN))


def test_golden_messages_with_empty_allow_list(spark):
    config = TransformConfig(allow_list=())
    classified = classify(decode(records(spark, [t for t, _ in GOLDEN])), config)
    stored = {r["offset"]: r for r in to_events(classified, config).collect()}
    assert set(stored) == {0, 1, 2, 5}
    assert (stored[5]["domain"], stored[5]["event_type"], stored[5]["entity_type"]) == ("unknown", "power_meter", "unknown")
    assert json.loads(stored[5]["data"]) == {"data": None}


def test_unknown_payload_keeps_only_the_data_object(spark):
    config = TransformConfig(allow_list=())
    texts = [message("odd", {"data": {"a": [1]}, "b": 2}), message("odd", {"data": None}), message("odd", {"data": 5})]
    classified = classify(decode(records(spark, texts)), config)
    assert [r["failed_check"] for r in classified.orderBy("offset").collect()] == [None, None, "payload_type"]
    data = [json.loads(r["data"]) for r in to_events(classified, config).orderBy("offset").collect()]
    assert data == [{"data": {"a": [1]}}, {"data": None}]


def test_each_case(spark):
    found = classify(decode(records(spark, [t for t, _ in CASES.values()]))).select("offset", "failed_check").collect()
    names = list(CASES)
    actual = {names[r["offset"]]: r["failed_check"] for r in found}
    assert actual == {n: check for n, (_, check) in CASES.items()}


def test_values_after_normalisation(spark):
    texts = [CASES[n][0] for n in ("derive power", "finance case and blanks", "clamped")] + [energy(123, 500, 240, 500)]
    rows = typed_payloads(to_events(classify(decode(records(spark, texts))))).orderBy("offset").collect()
    assert rows[0]["payload_energy_meter"]["power_w"] == 120
    assert rows[1]["payload_financial_stream"][1:] == ("EUR", "Globex", "pending")
    assert tuple(rows[2]["payload_temperature_sensor"]) == (100, 100, 500)
    assert rows[3]["payload_energy_meter"]["power_w"] == 123


def test_event_fields(spark):
    text = CASES["offset time"][0]
    event = to_events(classify(decode(records(spark, [text, text])))).orderBy("offset").collect()
    assert str(event[0]["occurred_at"]) == "2024-01-05 14:35:22.500000"
    assert event[0]["schema_version"] == "1.0.0"
    assert event[0]["entity_id"] == "dev-1"
    assert event[0]["event_id"] != event[1]["event_id"]


def test_failures_keep_the_raw_value_and_say_why(spark):
    rows = failure_rows(classify(decode(records(spark, ["junk", energy(-1, 0, 5, 5), message("x", {})]))), "b").orderBy("offset")
    found = rows.collect()
    assert [r["stage"] for r in found] == ["process", "transform", "transform"]
    assert found[0]["message"] == "" and found[0]["raw_value"] == "junk"
    assert found[1]["error"].startswith("field 'er': expected EnergyReading, got EnergyReading, because of failed to validate data")
    assert "energy_wh:required" in found[1]["error"]
    assert "unsupported domain: unknown (supported: [temperature_sensor " in found[2]["error"]
    assert json.loads(found[1]["message"])["metrics"]["voltage_v"] == 5
    dead = [json.loads(r["value"]) for r in dlq_records(rows).collect()]
    assert sorted(len(d) for d in dead) == [2, 3, 3]


def test_duplicate_keys_last_wins(spark):
    doubled = energy()[:-1] + ',"device_id":"last"}'
    assert decode(records(spark, [doubled])).first()["device_id"] == "last"


def test_last_header_wins(spark):
    frame = spark.sql("select array(named_struct('key','a','value','1'), named_struct('key','b','value','2'), named_struct('key','a','value','3')) h, cast(null as array<struct<key string, value string>>) none")
    row = frame.select(header_map(F.col("h")).alias("m"), header_map(F.col("none")).alias("n")).first()
    assert row["m"] == {"a": "3", "b": "2"} and row["n"] == {}


def test_a_type_is_registered_once():
    with pytest.raises(DuplicateDomain):
        default_registry().register(ENERGY)
