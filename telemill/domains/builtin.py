"""The built-in domains."""

from pyspark.sql import types as T

from telemill.domains.spec import DomainSpec, Registry, Rule
from telemill.functions.text import trim_space_sql


def required_number(p: str, field: str) -> Rule:
    """Zero counts as missing: an absent number decodes to zero."""
    return Rule(field, "required", f"{p}.{field} <> 0")


def required_text(p: str, field: str) -> Rule:
    return Rule(field, "required", f"{p}.{field} <> ''")


def at_least(p: str, field: str, low: float) -> Rule:
    return Rule(field, f"gte={low}", f"{p}.{field} >= {low}")


def at_most(p: str, field: str, high: float) -> Rule:
    return Rule(field, f"lte={high}", f"{p}.{field} <= {high}")


def clamp(value: str, low: float, high: float) -> str:
    return f"least(greatest({value}, {low}D), {high}D)"


def _normalize_energy(p: str) -> dict[str, str]:
    measured = f"greatest({p}.power_w, 0D)"
    derivable = f"{measured} = 0 AND {p}.voltage_v > 0 AND {p}.current_ma > 0"
    derived = f"CAST({p}.voltage_v AS DOUBLE) * CAST({p}.current_ma AS DOUBLE) / 1000"
    return {
        # Dividing and multiplying by ten does not round; it is kept because results must agree
        # to the last bit.
        "power_w": f"CASE WHEN {derivable} THEN {derived} ELSE {measured} END / 10 * 10",
        "energy_wh": f"greatest({p}.energy_wh, 0D)",
        "voltage_v": f"greatest({p}.voltage_v, 0F)",
        "current_ma": f"greatest({p}.current_ma, 0F)",
    }


ENERGY = DomainSpec(
    type="energy_meter",
    entity_type="sensor",
    source="energy_meter",
    schema=T.StructType(
        [
            T.StructField("power_w", T.DoubleType()),
            T.StructField("energy_wh", T.DoubleType()),
            T.StructField("voltage_v", T.FloatType()),
            T.StructField("current_ma", T.FloatType()),
        ]
    ),
    normalize=_normalize_energy,
    rules=lambda p: [
        required_number(p, "power_w"), at_least(p, "power_w", 0),
        required_number(p, "energy_wh"), at_least(p, "energy_wh", 0),
        required_number(p, "voltage_v"), at_least(p, "voltage_v", 0), at_most(p, "voltage_v", 500),
        required_number(p, "current_ma"), at_least(p, "current_ma", 0),
    ],
    payload_name="EnergyReading",
    payload_label="er",
)

FINANCE = DomainSpec(
    type="financial_stream",
    entity_type="device",
    source="financial_stream",
    schema=T.StructType(
        [
            T.StructField("amount_minor", T.DoubleType()),
            T.StructField("currency", T.StringType()),
            T.StructField("merchant", T.StringType()),
            T.StructField("status", T.StringType()),
        ]
    ),
    normalize=lambda p: {
        "currency": f"upper({trim_space_sql(f'{p}.currency')})",
        "merchant": trim_space_sql(f"{p}.merchant"),
        "status": f"lower({trim_space_sql(f'{p}.status')})",
    },
    rules=lambda p: [
        required_number(p, "amount_minor"),
        required_text(p, "currency"),
        required_text(p, "merchant"),
        required_text(p, "status"),
        Rule("status", "oneof", f"{p}.status IN ('completed', 'failed', 'pending')"),
    ],
    payload_name="FinancialTransaction",
    payload_label="ft",
)

ENVIRONMENT = DomainSpec(
    type="temperature_sensor",
    entity_type="sensor",
    source="temperature_sensor",
    schema=T.StructType(
        [
            T.StructField("temperature_c", T.DoubleType()),
            T.StructField("humidity_percent", T.DoubleType()),
            T.StructField("air_quality_index", T.DoubleType()),
        ]
    ),
    normalize=lambda p: {
        "temperature_c": clamp(f"{p}.temperature_c", -50, 100),
        "humidity_percent": clamp(f"{p}.humidity_percent", 0, 100),
        "air_quality_index": clamp(f"{p}.air_quality_index", 0, 500),
    },
    rules=lambda p: [
        required_number(p, "temperature_c"),
        at_least(p, "temperature_c", -50), at_most(p, "temperature_c", 100),
        required_number(p, "humidity_percent"),
        at_least(p, "humidity_percent", 0), at_most(p, "humidity_percent", 100),
        required_number(p, "air_quality_index"),
        at_least(p, "air_quality_index", 0), at_most(p, "air_quality_index", 500),
    ],
    payload_name="EnvironmentalSensor",
    payload_label="e",
)

UNKNOWN = DomainSpec(
    type="unknown",
    entity_type="unknown",
    source="unknown",
    schema=T.StructType([T.StructField("data", T.VariantType())]),
    normalize=lambda p: {},
    rules=lambda p: [],
    payload_name="UnknownEvent",
    payload_label="e",
)

BUILTIN = (FINANCE, ENERGY, ENVIRONMENT, UNKNOWN)


def default_registry() -> Registry:
    return Registry(BUILTIN)
