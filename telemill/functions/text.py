"""Text functions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from telemill import fixed
from telemill.functions.sql import quoted


def trim_space(c: Column) -> Column:
    """Strip every Unicode white-space character from both ends (plain ``trim`` strips blanks only)."""
    return F.btrim(c, F.lit(fixed.WHITESPACE))


def trim_space_sql(expression: str) -> str:
    """``trim_space`` as SQL text."""
    return f"btrim({expression}, {quoted(fixed.WHITESPACE)})"


def is_uuid(c: Column) -> Column:
    return F.coalesce(c.rlike(fixed.UUID_PATTERN), F.lit(False))


def is_semver(c: Column) -> Column:
    return F.coalesce(c.rlike(fixed.SEMVER_PATTERN), F.lit(False))


def truncate_bytes(c: Column, limit: int) -> Column:
    """Cap text at ``limit`` UTF-8 bytes, never splitting a character, and mark the cut."""
    if limit <= 0:
        return c
    data = F.encode(c, "UTF-8")

    def continues(position: int) -> Column:
        # Bytes 80..BF are inside a character, so a cut in front of one would split it.
        return F.hex(F.substring(data, position, 1)).between("80", "BF")

    # A character has at most four bytes: step back three positions at most.
    kept = F.lit(max(limit - 3, 0))
    for back in reversed(range(min(3, limit))):
        kept = F.when(~continues(limit + 1 - back), F.lit(limit - back)).otherwise(kept)
    cut = F.substring(data, F.lit(1), kept).cast("string")
    return F.when(F.octet_length(c) > limit, F.concat(cut, F.lit(fixed.TRUNCATED_SUFFIX))).otherwise(c)
