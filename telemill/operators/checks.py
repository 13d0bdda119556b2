"""Predicates on messages and events, as columns over the usual column names."""

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from telemill import fixed
from telemill.domains import Registry
from telemill.functions.sql import lookup, one_of, quoted

_ZERO_TIME = "TIMESTAMP_NTZ'0001-01-01 00:00:00'"


def _missing(column: str) -> str:
    return f"coalesce({column}, '') = ''"


def _no_time(column: str) -> str:
    return f"coalesce({column} = {_ZERO_TIME}, true)"


def raw_error_sql() -> str:
    return (
        f"CASE WHEN {_missing('device_id')} THEN {quoted(fixed.MISSING_DEVICE_ID)} "
        f"WHEN {_missing('type')} THEN {quoted(fixed.MISSING_TYPE)} "
        f"WHEN {_no_time('occurred_at')} THEN {quoted(fixed.MISSING_TIMESTAMP)} END"
    )


def raw_error() -> Column:
    """First missing required field of a decoded message; NULL when all are there. No trimming."""
    return F.expr(raw_error_sql())


def is_valid_type(type_name: Column) -> Column:
    return F.coalesce(type_name.isin(*fixed.VALID_TYPES), F.lit(False))


def parse_type(type_name: Column) -> Column:
    """The type itself when it is a known one, else ``unknown``. Exact and case-sensitive."""
    return F.when(type_name.isin(*fixed.VALID_TYPES), type_name).otherwise(F.lit(fixed.UNKNOWN_TYPE))


def allowed_sql(allow_list: Sequence[str]) -> str:
    return one_of("domain", allow_list) if allow_list else "true"


def is_allowed(allow_list: Sequence[str]) -> Column:
    """Membership of the domain in the allow-list; an empty list lets everything through."""
    return F.expr(allowed_sql(allow_list))


def registered_sql(registry: Registry) -> str:
    return one_of("domain", [s.type for s in registry])


def is_registered(registry: Registry) -> Column:
    return F.expr(registered_sql(registry))


def payload_violations(registry: Registry) -> Column:
    """Broken payload rules of the row's own domain."""
    rules = lookup("domain", {s.type: s.violations() for s in registry})
    return F.expr(f"coalesce({rules}, CAST(array() AS ARRAY<STRING>))")


def envelope_violations() -> Column:
    """Broken rules of the event envelope, one per field; ``transform.event_violations`` adds the payload's."""
    required = ["domain", "event_type", "entity_type", "source"]
    checks = {c: [(_missing(c), "required")] for c in required}
    checks |= {c: [(_no_time(c), "required")] for c in ("occurred_at", "ingested_at")}
    checks["event_id"] = [(f"coalesce(event_id, '') IN ('', {quoted(fixed.ZERO_UUID)})", "required")]
    checks["entity_id"] = [(_missing("entity_id"), "required"), ("length(entity_id) > 255", "max=255")]
    checks["schema_version"] = [
        (_missing("schema_version"), "required"),
        (f"NOT schema_version RLIKE {quoted(fixed.SEMVER_PATTERN)}", "semver"),
    ]
    checks["data"] = [("data IS NULL", "required")]
    order = [
        "event_id", "domain", "event_type", "entity_id", "entity_type", "occurred_at", "ingested_at",
        "source", "schema_version", "data",
    ]
    broken = [
        "CASE " + " ".join(f"WHEN {test} THEN {quoted(f'{c}:{rule}')}" for test, rule in checks[c]) + " END"
        for c in order
    ]
    return F.expr(f"array_compact(array({', '.join(broken)}))")
