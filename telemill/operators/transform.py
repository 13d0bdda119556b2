"""Decoded messages to typed domain events, with the reason for every message that fails."""

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from telemill import fixed
from telemill.domains import DomainSpec, Registry, default_registry
from telemill.functions.ids import event_id
from telemill.functions.sql import lookup, name, one_of, quoted
from telemill.functions.text import trim_space
from telemill.operators import checks
from telemill.operators.plan import evaluate_once


@dataclass(frozen=True)
class TransformConfig:
    registry: Registry = field(default_factory=default_registry)
    allow_list: Sequence[str] = fixed.VALID_TYPES


@dataclass(frozen=True)
class Failure:
    """How one failed check is reported."""

    stage: str
    error_type: str
    reason: str


# Checks in the order they are made; the first one that fails decides.
FAILURES = {
    "malformed": Failure(fixed.STAGE_PROCESS, "polling_message", fixed.REASON_POLL),
    fixed.MISSING_DEVICE_ID: Failure(fixed.STAGE_PROCESS, "validating_message", fixed.REASON_VALIDATE_MESSAGE),
    fixed.MISSING_TYPE: Failure(fixed.STAGE_PROCESS, "validating_message", fixed.REASON_VALIDATE_MESSAGE),
    fixed.MISSING_TIMESTAMP: Failure(fixed.STAGE_PROCESS, "validating_message", fixed.REASON_VALIDATE_MESSAGE),
    "unsupported_domain": Failure(fixed.STAGE_TRANSFORM, "validating_data", fixed.REASON_VALIDATE_DATA),
    "unknown_data_type": Failure(fixed.STAGE_TRANSFORM, "validating_data", fixed.UNKNOWN_DATA_TYPE),
    "metrics_missing": Failure(fixed.STAGE_TRANSFORM, "unmarshalling_message", "metrics_missing"),
    "payload_type": Failure(fixed.STAGE_TRANSFORM, "unmarshalling_message", fixed.REASON_UNMARSHAL),
    "payload_rules": Failure(fixed.STAGE_TRANSFORM, "validating_data", fixed.REASON_VALIDATE_DATA),
    "already_stored": Failure(fixed.STAGE_STORE, "storing_message", fixed.REASON_STORE),
}


def resolve_domain(messages: DataFrame, registry: Registry) -> DataFrame:
    """Add ``domain`` and the registered ``entity_type`` and ``source`` (NULL when unregistered).

    The registry is a handful of rows known when the plan is built, so the lookup is a literal
    expression: no join, no broadcast.
    """
    return messages.withColumn("domain", checks.parse_type(F.col("type"))).withColumns(
        {
            "entity_type": F.expr(registry.attribute("entity_type")),
            "source": F.expr(registry.attribute("source")),
        }
    )


def enrich_from_table(messages: DataFrame, registry_table: DataFrame) -> DataFrame:
    """The same lookup against a registry table; Spark broadcasts it when its size allows."""
    return messages.join(registry_table, "domain", "left")


def _parse_schema(spec: DomainSpec) -> str:
    """Numbers are parsed as such; texts stay VARIANT first, since the parser turns numbers to text."""
    kinds = {
        f.name: "variant" if isinstance(f.dataType, T.StringType) else f.dataType.simpleString() for f in spec.schema
    }
    return ", ".join(f"{name(n)} {kind}" for n, kind in kinds.items()) + ", _corrupt string"


def _value(spec: DomainSpec, f: T.StructField) -> str:
    """A payload field; absent and null become the zero value."""
    raw = f"{name(spec.column)}.{name(f.name)}"
    if isinstance(f.dataType, T.VariantType):
        return f"CASE WHEN NOT is_variant_null({raw}) THEN {raw} END"
    if isinstance(f.dataType, T.StringType):
        return f"coalesce(try_variant_get({raw}, '$', 'string'), '')"
    return f"coalesce({raw}, CAST(0 AS {f.dataType.simpleString()}))"


def _misfits(spec: DomainSpec) -> list[str]:
    """Conditions under which the JSON does not fit the declared fields; NULL counts as false."""
    conditions = [f"{name(spec.column)}._corrupt IS NOT NULL"]
    for f in spec.schema:
        raw = f"{name(spec.column)}.{name(f.name)}"
        if isinstance(f.dataType, T.VariantType):
            conditions.append(f"NOT is_variant_null({raw}) AND NOT startswith(to_json({raw}), '{{')")
        elif isinstance(f.dataType, T.StringType):
            conditions.append(f"schema_of_variant({raw}) NOT IN ('STRING', 'VOID')")
        else:
            conditions.append(f"abs({raw}) = {f.dataType.simpleString()}('Infinity')")
    return conditions


def decode_payload(messages: DataFrame, registry: Registry) -> DataFrame:
    """Add one typed payload struct per domain (NULL but for the row's own) and ``is_misfit``."""
    options = "map('columnNameOfCorruptRecord', '_corrupt', 'allowNonNumericNumbers', 'false')"
    parsed, misfits, payloads = {}, [], {}
    for s in registry:
        p = name(s.column)
        parse = f"from_json(metrics, {quoted(_parse_schema(s))}, {options})"
        parsed[s.column] = F.expr(f"CASE WHEN domain = {quoted(s.type)} AND metrics IS NOT NULL THEN {parse} END")
        misfits += _misfits(s)
        fields = ", ".join(f"{quoted(f.name)}, {_value(s, f)}" for f in s.schema)
        payloads[s.column] = F.expr(f"CASE WHEN {p} IS NOT NULL THEN named_struct({fields}) END")
    # Tested as an array: a lambda keeps this step out of the fused loop, whose method would grow
    # beyond the 8000 bytes the JVM is willing to compile.
    is_misfit = F.expr(f"coalesce(exists(array({', '.join(misfits)}), broken -> broken), false)")
    return messages.withColumns(parsed).withColumns({**payloads, "is_misfit": is_misfit})


def normalize_payload(messages: DataFrame, registry: Registry) -> DataFrame:
    """Apply every domain's normalisation to its payload column."""
    return messages.withColumns({s.column: F.expr(s.normalized()) for s in registry})


def classify(decoded: DataFrame, config: TransformConfig | None = None) -> DataFrame:
    """Judge every decoded message. ``failed_check`` is NULL for the good ones.

    Steps, first failure wins: well-formed, required fields, allow-list, registry, payload decode,
    normalise, payload rules. One narrow stage, no shuffle, one row out per row in.
    """
    config = config or TransformConfig()
    registry = config.registry
    resolved = resolve_domain(decoded, registry)
    typed = normalize_payload(decode_payload(resolved, registry), registry)
    ruled = typed.withColumn("violations", checks.payload_violations(registry))
    judged = ruled.withColumn(
        "failed_check",
        F.expr(
            f"""CASE
            WHEN is_malformed THEN 'malformed'
            WHEN {checks.raw_error_sql()} IS NOT NULL THEN {checks.raw_error_sql()}
            WHEN NOT {checks.allowed_sql(config.allow_list)} THEN 'unsupported_domain'
            WHEN NOT {checks.registered_sql(registry)} THEN 'unknown_data_type'
            WHEN metrics IS NULL THEN 'metrics_missing'
            WHEN is_misfit THEN 'payload_type'
            WHEN size(violations) > 0 THEN 'payload_rules'
            END"""
        ),
    )
    computed = [
        "domain", "entity_type", "source", *[s.column for s in registry], "violations", "failed_check",
    ]
    once = evaluate_once(judged.drop("is_malformed", "is_misfit"), computed)
    return once.withColumn("stage", _by_check("stage"))


def _by_check(attribute: str) -> Column:
    """Attribute of the failed check, as a literal lookup."""
    return F.expr(lookup("failed_check", {c: quoted(getattr(f, attribute)) for c, f in FAILURES.items()}))


def payload_json(registry: Registry) -> Column:
    """JSON text of the row's own payload; a missing object is written as null."""
    texts = {s.type: f"to_json({name(s.column)}, map('ignoreNullFields', 'false'))" for s in registry}
    return F.expr(lookup("domain", texts))


def compact(classified: DataFrame, registry: Registry) -> DataFrame:
    """Payload structs replaced by their JSON text, for keeping a batch."""
    texts = classified.withColumn("data", payload_json(registry))
    return texts.drop("headers", *[s.column for s in registry])


def to_events(
    classified: DataFrame, config: TransformConfig | None = None, keep: Sequence[str] = ()
) -> DataFrame:
    """The good messages as events. ``ingested_at`` is the arrival time of the record, so a replay
    gives the same event and lands in the same ``ingest_date``."""
    config = config or TransformConfig()
    return classified.where(F.col("failed_check").isNull()).select(
        event_id(F.col("record_key")).alias("event_id"),
        "domain",
        F.col("type").alias("event_type"),
        F.col("device_id").alias("entity_id"),
        "entity_type",
        "occurred_at",
        F.col("arrived_at").alias("ingested_at"),
        "source",
        F.lit(fixed.SCHEMA_VERSION).alias("schema_version"),
        F.col("data") if "data" in classified.columns else payload_json(config.registry).alias("data"),
        F.lit(None).cast("string").alias("metadata"),
        "topic",
        "partition",
        "offset",
        F.to_date("arrived_at").alias("ingest_date"),
        *keep,
    )


def _by_type(registry: Registry, results: dict[str, str], otherwise: str) -> Column:
    """One of ``results`` by the row's event type; types that are not registered count as unknown."""
    known = one_of("event_type", [s.type for s in registry])
    kind = f"CASE WHEN {known} THEN event_type ELSE {quoted(fixed.UNKNOWN_TYPE)} END"
    return F.expr(lookup(kind, results, otherwise))


def event_violations(events: DataFrame, registry: Registry | None = None) -> DataFrame:
    """Add ``violations``: the broken rules of the envelope, then those of the payload of its type."""
    registry = registry or default_registry()
    none = "CAST(array() AS ARRAY<STRING>)"
    of_payload = F.coalesce(_by_type(registry, {s.type: s.violations() for s in registry}, none), F.expr(none))
    broken = F.concat(checks.envelope_violations(), of_payload)
    return typed_payloads(events, registry).withColumn("violations", broken).drop(*[s.column for s in registry])


def normalize_events(events: DataFrame, registry: Registry | None = None) -> DataFrame:
    """Normalise the envelope and the payload of the type the row was stored with.

    A payload that cannot be decoded, or whose domain has nothing to normalise, stays as it is.
    """
    registry = registry or default_registry()
    texts = {
        s.type: f"coalesce(to_json({name(s.column)}, map('ignoreNullFields', 'false')), data)"
        for s in registry
        if s.normalize(name(s.column))
    }
    typed = normalize_payload(typed_payloads(events, registry), registry)
    rewritten = typed.withColumn("data", _by_type(registry, texts, "data"))
    return normalize_envelope(rewritten.drop(*[s.column for s in registry]))


def normalize_envelope(events: DataFrame) -> DataFrame:
    """Standard spelling of the envelope fields and defaults for the empty ones.

    Times are UTC already. The default schema version is not a valid semantic version and so does
    not pass the envelope rules; this is how the data model defines it.
    """

    def text(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(""))

    return events.withColumns(
        {
            "domain": F.lower(trim_space(text("domain"))),
            "event_type": F.lower(F.replace(trim_space(text("event_type")), F.lit(" "), F.lit("_"))),
            "entity_type": F.lower(trim_space(text("entity_type"))),
            "source": F.when(text("source") == "", F.lit(fixed.DEFAULT_SOURCE)).otherwise(F.col("source")),
            "schema_version": F.when(
                text("schema_version") == "", F.lit(fixed.DEFAULT_SCHEMA_VERSION)
            ).otherwise(F.col("schema_version")),
        }
    )


def typed_payloads(events: DataFrame, registry: Registry | None = None) -> DataFrame:
    """Re-type ``data`` by ``event_type``, unregistered types as the unknown payload."""
    registry = registry or default_registry()
    known = [s for s in registry if s.type != fixed.UNKNOWN_TYPE]
    type_name = f"CASE WHEN {one_of('event_type', fixed.VALID_TYPES)} THEN event_type ELSE {quoted(fixed.UNKNOWN_TYPE)} END"
    columns = {}
    for s in registry:
        if s.type == fixed.UNKNOWN_TYPE:
            mine = f"NOT {one_of(type_name, [k.type for k in known])}" if known else "true"
        else:
            mine = f"{type_name} = {quoted(s.type)}"
        ddl = ", ".join(f"{name(f.name)} {f.dataType.simpleString()}" for f in s.schema)
        columns[s.column] = F.expr(f"CASE WHEN {mine} THEN from_json(data, {quoted(ddl)}) END")
    return events.withColumns(columns)
