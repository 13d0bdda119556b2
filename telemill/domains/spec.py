"""A domain is declared as SQL expressions, so user domains stay inside generated code."""

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from telemill.functions.sql import lookup, name, quoted


class DuplicateDomain(ValueError):
    """A message type was registered twice."""


@dataclass(frozen=True)
class Rule:
    """A condition on a normalised payload. The first failing rule of a field is reported."""

    field: str
    name: str
    passes: str


@dataclass(frozen=True)
class DomainSpec:
    """``normalize`` and ``rules`` are given the payload's column name, so that a field is written
    ``f"{p}.power_w"``. ``normalize`` gives the changed fields, ``rules`` the rules, both as SQL.

    Schema fields are DOUBLE, FLOAT, STRING, or VARIANT for a free-form object.
    """

    type: str
    entity_type: str
    source: str
    schema: T.StructType
    normalize: Callable[[str], dict[str, str]]
    rules: Callable[[str], list[Rule]]
    payload_name: str = "Payload"
    payload_label: str = "payload"

    @property
    def column(self) -> str:
        """Name of the payload column while events are in flight."""
        return f"payload_{self.type}"

    def normalized(self) -> str:
        """The payload struct after normalisation; NULL stays NULL."""
        p = name(self.column)
        changed = self.normalize(p)
        fields = []
        for f in self.schema:
            value = changed.get(f.name, f"{p}.{name(f.name)}")
            if not isinstance(f.dataType, T.VariantType):
                value = f"CAST({value} AS {f.dataType.simpleString()})"
            fields.append(f"{quoted(f.name)}, {value}")
        return f"CASE WHEN {p} IS NOT NULL THEN named_struct({', '.join(fields)}) END"

    def violations(self) -> str:
        """Broken rules as ``field:rule``, one per field, in field order."""
        by_field: dict[str, list[Rule]] = {}
        for rule in self.rules(name(self.column)):
            by_field.setdefault(rule.field, []).append(rule)
        if not by_field:
            return "CAST(array() AS ARRAY<STRING>)"
        first_broken = [
            "CASE " + " ".join(f"WHEN NOT ({r.passes}) THEN {quoted(f'{r.field}:{r.name}')}" for r in rules) + " END"
            for rules in by_field.values()
        ]
        return f"array_compact(array({', '.join(first_broken)}))"


class Registry:
    """The registered domains. Registering gives a new registry; a type can be taken once."""

    def __init__(self, specs: Iterable[DomainSpec] = ()):
        self._specs: dict[str, DomainSpec] = {}
        for spec in specs:
            if spec.type in self._specs:
                raise DuplicateDomain(f'domain "{spec.type}" already registered')
            self._specs[spec.type] = spec

    def register(self, spec: DomainSpec) -> "Registry":
        return Registry([*self._specs.values(), spec])

    def lookup(self, type_name: str) -> DomainSpec | None:
        return self._specs.get(type_name)

    def __iter__(self):
        return iter(self._specs.values())

    def __len__(self) -> int:
        return len(self._specs)

    def attribute(self, attribute: str, domain: str = "domain") -> str:
        """One attribute of a row's domain, as a literal lookup; NULL when unregistered."""
        return lookup(domain, {s.type: quoted(getattr(s, attribute)) for s in self})

    def to_dataframe(self, spark: SparkSession) -> DataFrame:
        """The registry as a table: one row per registered domain."""
        rows = [(s.type, s.entity_type, s.source) for s in self]
        return spark.createDataFrame(rows, "domain string, entity_type string, source string")
