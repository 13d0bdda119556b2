"""Views that are safe to log: chosen columns, redaction by key, capped text."""

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from telemill import fixed
from telemill.functions.text import truncate_bytes


def message_view(messages: DataFrame) -> DataFrame:
    """A message without its metrics."""
    return messages.select("device_id", "type", F.col("occurred_at").alias("timestamp"))


def event_view(events: DataFrame) -> DataFrame:
    """An event without entity and payload."""
    return events.select("event_id", "domain", "event_type", "entity_type", "schema_version")


def finance_view(payload: Column) -> Column:
    """A transaction without its merchant; the amount as text."""
    amount = payload["amount_minor"]
    return F.struct(
        payload["currency"].alias("currency"),
        payload["status"].alias("status"),
        plain_number(amount).alias("amount"),
    )


def plain_number(c: Column) -> Column:
    """Shortest decimal text of a double of any size, without an exponent and without a trailing ``.0``."""
    text = c.cast("string")
    bare = F.ltrim(text, F.lit("-"))
    digits = F.replace(F.split_part(bare, F.lit("E"), F.lit(1)), F.lit("."), F.lit(""))
    whole = F.split_part(bare, F.lit("E"), F.lit(2)).try_cast("int") + 1
    padded = F.concat(digits, F.repeat(F.lit("0"), whole - F.length(digits)))
    large = F.concat(F.substring(padded, F.lit(1), whole), F.lit("."), F.substring(padded, whole + 1, F.length(padded)))
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -whole), digits)
    plain = F.when(whole.isNull(), bare).when(whole > 0, large).otherwise(small)
    short = F.when(plain.contains("."), F.regexp_replace(plain, r"\.?0*$", "")).otherwise(plain)
    return F.concat(F.when(text.startswith("-"), F.lit("-")).otherwise(F.lit("")), short)


def redact(
    frame: DataFrame,
    keys: Iterable[str] = fixed.REDACT_KEYS,
    max_value_bytes: int = fixed.MAX_VALUE_BYTES,
) -> DataFrame:
    """Replace every value under a listed key, at any depth, and cap the remaining text.

    Keys are compared exactly. The schema is walked when the plan is built; rows are only touched by
    generated code.
    """
    hidden = frozenset(keys)
    return frame.select(
        *[_field(F.col(f"`{f.name}`"), f.name, f.dataType, hidden, max_value_bytes).alias(f.name) for f in frame.schema]
    )


def _field(c: Column, name: str, kind: T.DataType, hidden: frozenset[str], cap: int) -> Column:
    return F.lit(fixed.REDACTED) if name in hidden else _value(c, kind, hidden, cap)


def _value(c: Column, kind: T.DataType, hidden: frozenset[str], cap: int) -> Column:
    if isinstance(kind, T.StringType):
        return truncate_bytes(c, cap)
    if isinstance(kind, T.StructType):
        fields = [_field(c[f.name], f.name, f.dataType, hidden, cap).alias(f.name) for f in kind]
        return F.when(c.isNotNull(), F.struct(*fields))
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda e: _value(e, kind.elementType, hidden, cap))
    if isinstance(kind, T.MapType) and not isinstance(kind.keyType, T.StringType):
        return F.transform_values(c, lambda k, v: _value(v, kind.valueType, hidden, cap))
    if isinstance(kind, T.MapType):
        return F.transform_values(c, lambda k, v: F.when(k.isin(*hidden), F.lit(fixed.REDACTED)).otherwise(_text(v, kind.valueType, hidden, cap)))
    return c


def _text(v: Column, kind: T.DataType, hidden: frozenset[str], cap: int) -> Column:
    """A map value as text, since a redacted entry turns the whole map into text."""
    if isinstance(kind, T.StringType):
        return truncate_bytes(v, cap)
    if isinstance(kind, T.StructType | T.ArrayType | T.MapType):
        return F.to_json(_value(v, kind, hidden, cap))
    return v.cast("string")
