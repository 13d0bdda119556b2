"""Page sizes and page cursors."""

import base64
import binascii
import json
import re
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

from telemill import fixed
from telemill.functions.times import format_rfc3339, parse_rfc3339


class InvalidCursor(ValueError):
    """The page token cannot be decoded."""


@dataclass(frozen=True)
class Cursor:
    """Position of the last row of a page, in newest-first order."""

    ingested_at: datetime
    event_id: str


def clamp_limit(
    value: int | None,
    low: int = fixed.MIN_PAGE_SIZE,
    high: int = fixed.MAX_PAGE_SIZE,
    fallback: int = fixed.DEFAULT_PAGE_SIZE,
) -> int:
    if value is None or value <= 0:
        return fallback
    return min(max(value, low), high)


def clamp_limit_column(
    c: Column,
    low: int = fixed.MIN_PAGE_SIZE,
    high: int = fixed.MAX_PAGE_SIZE,
    fallback: int = fixed.DEFAULT_PAGE_SIZE,
) -> Column:
    clamped = F.least(F.greatest(c, F.lit(low)), F.lit(high))
    return F.when(c > 0, clamped).otherwise(F.lit(fallback))


def parse_int_or_default(c: Column, fallback: int) -> Column:
    """A positive whole number in plain decimal text, else the fallback."""
    number = F.when(c.rlike(r"^[+-]?\d+\z"), c.try_cast("bigint"))
    return F.when(number > 0, number).otherwise(F.lit(fallback).cast("bigint"))


def cursor_column(ingested_at: Column, event_id: Column) -> Column:
    """Page token: base64url without padding of ``{"t": …, "id": …}``."""
    text = F.to_json(F.struct(format_rfc3339(ingested_at).alias("t"), event_id.alias("id")))
    return F.rtrim(F.translate(F.base64(text.cast("binary")), "+/\r\n", "-_"), F.lit("="))


def decode_cursor_column(token: Column) -> Column:
    """``STRUCT<ingested_at, event_id>`` of a page token; NULL where the token is invalid."""
    alphabet = token.rlike(r"^[A-Za-z0-9_-]*\z")
    raw = F.try_to_binary(F.translate(token, "-_", "+/"), F.lit("base64")).cast("string")
    body = F.from_json(raw, "t string, id string")
    at = parse_rfc3339(body["t"])
    return F.when(
        alphabet & at.isNotNull() & body["id"].isNotNull(),
        F.struct(at.alias("ingested_at"), body["id"].alias("event_id")),
    )


def decode_cursor(token: str) -> Cursor:
    """Decode one page token on the caller's side."""
    try:
        if not re.fullmatch(r"[A-Za-z0-9_-]*", token):
            raise ValueError("not base64url")
        padded = token + "=" * (-len(token) % 4)
        body = json.loads(base64.b64decode(padded, altchars=b"-_", validate=True))
        at = datetime.fromisoformat(body["t"])
        return Cursor(at.astimezone(timezone.utc).replace(tzinfo=None), str(body["id"]))
    except (binascii.Error, ValueError, KeyError, TypeError) as error:
        raise InvalidCursor(f"{fixed.INVALID_CURSOR}: {error}") from error
