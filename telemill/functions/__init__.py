"""Column functions shared by the operators."""

from telemill.functions.ids import event_id, uuid_text
from telemill.functions.paging import (
    Cursor,
    InvalidCursor,
    clamp_limit,
    clamp_limit_column,
    cursor_column,
    decode_cursor,
    decode_cursor_column,
    parse_int_or_default,
)
from telemill.functions.text import is_semver, is_uuid, trim_space, truncate_bytes
from telemill.functions.times import format_rfc3339, parse_rfc3339, truncate_second, utc

__all__ = [
    "Cursor", "InvalidCursor", "clamp_limit", "clamp_limit_column", "cursor_column",
    "decode_cursor", "decode_cursor_column", "event_id", "format_rfc3339", "is_semver", "is_uuid",
    "parse_int_or_default", "parse_rfc3339", "trim_space", "truncate_bytes", "truncate_second", "utc", "uuid_text",
]
