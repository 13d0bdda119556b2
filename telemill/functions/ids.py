"""Deterministic identifiers, so that replays give the same keys."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def uuid_text(*parts: Column) -> Column:
    """md5 of the parts in the 8-4-4-4-12 layout of a UUID."""
    digest = F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]))
    return F.concat_ws(
        "-",
        F.substring(digest, 1, 8),
        F.substring(digest, 9, 4),
        F.substring(digest, 13, 4),
        F.substring(digest, 17, 4),
        F.substring(digest, 21, 12),
    )


def event_id(*more: Column) -> Column:
    """Key of the record at (topic, partition, offset).

    ``more`` widens the position of records that come from no topic; a NULL part changes nothing.
    """
    return uuid_text(F.col("topic"), F.col("partition"), F.col("offset"), *more)
