"""Event domains: what a payload looks like, how it is normalised, which rules it must meet."""

from telemill.domains.builtin import BUILTIN, ENERGY, ENVIRONMENT, FINANCE, UNKNOWN, default_registry
from telemill.domains.spec import DomainSpec, DuplicateDomain, Registry, Rule

__all__ = [
    "BUILTIN", "DomainSpec", "DuplicateDomain", "ENERGY", "ENVIRONMENT", "FINANCE", "Registry",
    "Rule", "UNKNOWN", "default_registry",
]
