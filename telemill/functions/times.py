"""Time functions. Every time is a UTC wall-clock ``TIMESTAMP_NTZ``."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from telemill import fixed


def utc(c: Column) -> Column:
    """The UTC wall clock of an instant (``TIMESTAMP``), whatever the session time zone."""
    return F.convert_timezone(None, F.lit("UTC"), c)


def parse_rfc3339(c: Column) -> Column:
    """Strict RFC 3339 text to UTC; NULL for anything else.

    The offset is applied here because a plain cast refuses offsets above 18 hours and accepts
    bare dates. Digits beyond microseconds are cut off.
    """
    zulu = c.endswith("Z")
    # The pattern fixes the shape: 19 characters of date and time, a fraction, Z or an offset.
    zone_length = F.when(zulu, 1).otherwise(6)
    fraction = F.substring(c, F.lit(20), F.least(F.length(c) - 19 - zone_length, F.lit(7)))
    clock = F.concat(F.substring(c, 1, 19), fraction).try_cast("timestamp_ntz")
    offset_minutes = F.substring(c, -5, 2).try_cast("int") * 60 + F.substring(c, -2, 2).try_cast("int")
    sign = F.when(F.substring(c, -6, 1) == "-", -1).otherwise(1)
    shifted = clock - F.make_dt_interval(mins=sign * offset_minutes)
    return F.when(c.rlike(fixed.RFC3339_PATTERN), F.when(zulu, clock).otherwise(shifted))


def format_rfc3339(c: Column) -> Column:
    """UTC time as RFC 3339 text without trailing zeros in the fraction."""
    return F.concat(F.translate(c.cast("string"), " ", "T"), F.lit("Z"))


def truncate_second(c: Column) -> Column:
    """Drop the fraction of a second (``date_trunc`` would go through the session time zone)."""
    return F.substring(c.cast("string"), 1, 19).cast("timestamp_ntz")
