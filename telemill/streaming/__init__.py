"""Continuous ingestion."""

from telemill.streaming.ingest import (
    FailureSinksUnavailable,
    IngestJob,
    outcome_counts,
    table_then_dlq,
    with_fallback,
)
from telemill.streaming.observe import observe_outcomes

__all__ = [
    "FailureSinksUnavailable", "IngestJob", "observe_outcomes", "outcome_counts", "table_then_dlq",
    "with_fallback",
]
