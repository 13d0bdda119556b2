"""Reads on the event table: point lookup, newest-first pages, filtered top-N, exports."""

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from telemill import fixed
from telemill.domains import Registry, default_registry
from telemill.functions.paging import clamp_limit, cursor_column, decode_cursor
from telemill.functions.sql import quoted
from telemill.operators.transform import decode_payload
from telemill.scratch import enable_checkpoints


class EventNotFound(LookupError):
    """No event has the requested id."""


@dataclass(frozen=True)
class Page:
    items: DataFrame
    next_cursor: str | None
    has_more: bool


def _newest_first() -> list[Column]:
    return [F.desc("ingested_at"), F.desc("event_id")]


def get_event(events: DataFrame, event_id: str) -> DataFrame:
    """The event with this id, or no row."""
    return events.where(F.col("event_id") == event_id).limit(1)


def require_event(events: DataFrame, event_id: str) -> DataFrame:
    """As ``get_event``, but a missing event is an error."""
    found = get_event(events, event_id)
    if found.isEmpty():
        raise EventNotFound(fixed.EVENT_NOT_FOUND)
    return found


def events_by_domain(events: DataFrame, domain: str, limit: int) -> DataFrame:
    """Latest occurrences in a domain; the domain prunes partitions, the limit is a top-k."""
    return events.where(F.col("domain") == domain).orderBy(F.desc("occurred_at"), F.desc("event_id")).limit(limit)


def events_by_source(events: DataFrame, source: str, limit: int) -> DataFrame:
    return events.where(F.col("source") == source).orderBy(*_newest_first()).limit(limit)


def before(ingested_at: datetime | Column, event_id: str | Column) -> Column:
    """Keyset predicate ``(ingested_at, event_id) < (t, id)``.

    Written out instead of comparing tuples: this form gives the reader the range ``ingested_at <=
    t`` to skip row groups with.
    """
    t = ingested_at if isinstance(ingested_at, Column) else F.lit(ingested_at.isoformat(" ")).cast("timestamp_ntz")
    i = event_id if isinstance(event_id, Column) else F.lit(event_id)
    at = F.col("ingested_at")
    return (at <= t) & ((at < t) | (F.col("event_id") < i))


def recent_days(events: DataFrame, rows: int) -> DataFrame:
    """Only the newest days, as many as it takes to hold ``rows`` rows.

    ``ingest_date`` is the day of ``ingested_at``, so older days cannot be on the page. Counting
    rows per day reads no column data, and one row per day is all that is ranked.
    """
    per_day = events.groupBy("ingest_date").agg(F.count("*").alias("n"))
    newest = Window.orderBy(F.desc("ingest_date")).rowsBetween(Window.unboundedPreceding, -1)
    newer = F.coalesce(F.sum("n").over(newest), F.lit(0))
    first_day = per_day.withColumn("newer", newer).where(F.col("newer") < rows).agg(F.min("ingest_date")).first()[0]
    return events if first_day is None else events.where(F.col("ingest_date") >= F.lit(first_day))


def newest_rows(events: DataFrame, limit: int) -> DataFrame:
    """The newest events of a frame that holds only the days it needs (``Tables.newest``): a top-k, no count."""
    return events.orderBy(*_newest_first()).limit(limit)


def list_first_page(events: DataFrame, limit: int) -> DataFrame:
    """The newest events, as a top-k over the newest days only."""
    return recent_days(events, limit).orderBy(*_newest_first()).limit(limit)


def list_after_cursor(events: DataFrame, ingested_at: datetime, event_id: str, limit: int) -> DataFrame:
    """The events that follow a position in newest-first order.

    Rows that share the position's time are compared by id, so ties are neither lost nor repeated.
    """
    older = events.where(before(ingested_at, event_id) & (F.col("ingest_date") <= F.lit(ingested_at.date())))
    return recent_days(older, limit).orderBy(*_newest_first()).limit(limit)


def list_page(events: DataFrame, limit: int | None = None, cursor: str | None = None) -> Page:
    """One page and the token of the next. One row more than the page is fetched to see whether
    there is a next page; those rows, at most a page and one, come to the caller."""
    size = clamp_limit(limit)
    if cursor:
        position = decode_cursor(cursor)
        wanted = list_after_cursor(events, position.ingested_at, position.event_id, size + 1)
    else:
        wanted = list_first_page(events, size + 1)
    fetched = wanted.withColumn("_token", cursor_column(F.col("ingested_at"), F.col("event_id"))).collect()
    page = fetched[:size]
    has_more = len(fetched) > size
    items = events.sparkSession.createDataFrame([row[:-1] for row in page], events.schema)
    return Page(items, page[-1]["_token"] if has_more else None, has_more)


def page_numbers(events: DataFrame, page_size: int) -> DataFrame:
    """Number every event's page in one pass over the table, newest first, for bulk export.

    The rows are range-partitioned and sorted once and kept by a checkpoint, so that the slices
    that are counted are the slices that are numbered. A row's place is then its place in its slice
    plus the size of the slices before it; only one count per slice is gathered.
    """
    enable_checkpoints(events.sparkSession)
    ordered = events.select("event_id", "ingested_at").orderBy(*_newest_first()).checkpoint()
    # Slice number above bit 33, place in the slice below.
    placed = ordered.withColumn("_id", F.monotonically_increasing_id())
    slice_of = F.shiftright("_id", 33).alias("_slice")
    sizes = placed.groupBy(slice_of).agg(F.count("*").alias("_n"))
    earlier = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_slice", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    # One row per slice: a few thousand at most.
    numbered = placed.withColumn("_slice", F.shiftright("_id", 33)).join(offsets, "_slice")
    position = F.col("_before") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    return numbered.select(
        "event_id",
        "ingested_at",
        position.alias("position"),
        F.floor(position / page_size).alias("page"),
    )


def response(events: DataFrame) -> DataFrame:
    """The public columns of an event."""
    return events.select(
        "event_id", "domain", "event_type", "entity_id", "occurred_at", "source", "schema_version", "data"
    )


def read_errors(events: DataFrame, registry: Registry | None = None) -> DataFrame:
    """Add ``read_error``: why a stored row cannot be read back, NULL when it can.

    The payload is decoded as strictly as a message's: one JSON value and nothing after it, and the
    JSON type of every field as declared. Types that are not registered are read as unknown payloads.
    """
    registry = registry or default_registry()
    kinds = [quoted(s.type) for s in registry]
    kind = f"CASE WHEN event_type IN ({', '.join(kinds)}) THEN event_type ELSE {quoted(fixed.UNKNOWN_TYPE)} END"
    stored = events.select(
        F.struct(*[F.col(f"`{c}`") for c in events.columns]).alias("_event"),
        F.expr(kind).alias("domain"),
        F.col("data").alias("metrics"),
        # As an array element the value may not be followed by anything.
        F.expr("coalesce(size(from_json(concat('[', data, ',null]'), 'array<variant>')) = 2, false)").alias("_one"),
    )
    return decode_payload(stored, registry).select(
        "_event.*",
        F.expr(
            "CASE WHEN NOT _one OR is_misfit THEN 'payload cannot be decoded' "
            f"WHEN NOT coalesce(_event.event_id RLIKE {quoted(fixed.READABLE_UUID_PATTERN)}, false) THEN 'invalid event UUID' END"
        ).alias("read_error"),
    )


def require_readable(events: DataFrame, registry: Registry | None = None) -> DataFrame:
    """Pass readable rows on and fail the query at the first unreadable one."""
    checked = read_errors(events, registry)
    failing = F.when(F.col("read_error").isNotNull(), F.raise_error(F.concat_ws(" ", "read_error", "event_id")).isNull())
    return checked.where(F.coalesce(failing, F.lit(True))).drop("read_error")
