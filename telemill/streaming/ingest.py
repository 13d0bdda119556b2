"""One micro-batch: decode, classify, check keys, append, quarantine.

The work is the same for a stream and for a backfill; only the caller differs.
"""

import hashlib
import logging
from collections.abc import Callable
from contextlib import ExitStack
from dataclasses import dataclass, field
from functools import partial

from py4j.protocol import Py4JError
from pyspark import InheritableThread, StorageLevel
from pyspark.errors import (
    AnalysisException, ParseException, PySparkAttributeError, PySparkException, PySparkTypeError, PySparkValueError,
)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from telemill import fixed
from telemill.operators import keyfilter, quarantine, store
from telemill.operators.decode import decode
from telemill.operators.transform import TransformConfig, classify, compact, to_events
from telemill.streaming.observe import ProgressMetrics

log = logging.getLogger(__name__)

Sink = Callable[[DataFrame], None]


class FailureSinksUnavailable(RuntimeError):
    """Neither failure sink took the failed messages."""


#: What a store that is down raises, here or in a job; and those among them that a wrong plan raises.
STORE_ERRORS = (OSError, Py4JError, PySparkException)
OWN_ERRORS = (AnalysisException, ParseException, PySparkTypeError, PySparkValueError, PySparkAttributeError)


def with_fallback(primary: Sink, secondary: Sink) -> Sink:
    """A sink that uses ``secondary`` only when ``primary`` fails.

    When both fail the error is raised: the query stops, its checkpoint does not advance, and the
    restart repeats the batch instead of losing the messages. Only failures of a store or of a running
    job count; an error of our own, such as a plan that cannot be resolved, is raised as it is.
    """

    def write(frame: DataFrame) -> None:
        try:
            primary(frame)
        except STORE_ERRORS as first:
            if isinstance(first, OWN_ERRORS):
                raise
            log.warning("primary failure sink failed, using the secondary: %s", first)
            try:
                secondary(frame)
            except STORE_ERRORS as second:
                raise FailureSinksUnavailable("all failure backends unavailable") from second

    return write


def table_then_dlq(tables: store.Tables, dead_letters: Sink) -> Sink:
    """The quarantine table as failure sink, and dead-letter records when it does not take the rows.

    ``dead_letters`` takes ``key`` and ``value``, e.g. ``partial(write_dlq, config=kafka)``.
    """
    return with_fallback(
        partial(store.append_failures, path=tables.failed_path),
        lambda failed: dead_letters(quarantine.dlq_records(failed)),
    )


def outcome_counts(classified: DataFrame, conflicts: DataFrame | None = None) -> DataFrame:
    """Messages by stage they failed in (NULL: none), domain and type.

    ``conflicts``, the events that the key check refused, are counted in the stage ``store``.
    """
    counts = classified.groupBy("stage", "domain", F.col("type").alias("event_type")).agg(F.count("*").alias("n"))
    if conflicts is None:
        return counts
    refused = conflicts.groupBy("domain", "event_type").agg(F.count("*").alias("n"))
    none = F.lit(None).cast("string")
    moved = refused.withColumn("stage", F.lit(fixed.STAGE_STORE)).unionByName(
        refused.withColumns({"stage": none, "n": -F.col("n")})
    )
    both = counts.unionByName(moved).groupBy("stage", "domain", "event_type")
    return both.agg(F.sum("n").alias("n")).where("n <> 0")


def side_by_side(*steps: Callable[[], None]) -> None:
    """Run independent steps at the same time: the jobs of a micro-batch are short, and one fills no cluster.

    All of them have ended when this returns; the first error, in the order of the steps, is raised then.
    """
    errors: list[BaseException | None] = [None] * len(steps)

    def run(k: int) -> None:
        try:
            steps[k]()
        except BaseException as error:  # raised below, in the caller's thread
            errors[k] = error

    others = [InheritableThread(target=run, args=(k,)) for k in range(1, len(steps))]
    for thread in others:
        thread.start()
    if steps:
        run(0)
    for thread in others:
        thread.join()
    for error in errors:
        if error is not None:
            raise error


@dataclass
class IngestJob:
    """Stages are replaceable: any function from DataFrame to DataFrame, any sink."""

    tables: store.Tables
    config: TransformConfig = field(default_factory=TransformConfig)
    decode: Callable[[DataFrame], DataFrame] = decode
    event_sink: Sink | None = None
    failure_sink: Sink | None = None
    on_counts: Callable[[str, DataFrame], None] | None = None
    # The judged batch is read several times. By default Spark keeps it in memory and on local disk,
    # which suits a micro-batch. A folder shared by the executors keeps it as a table there, which
    # suits a backfill larger than the cluster's memory and does not depend on any executor.
    staging: str | None = None

    def run(self, messages: DataFrame, batch_id: str) -> None:
        """Ingest a bounded set of messages. Repeating a batch id adds nothing."""
        with ExitStack() as used:

            def kept(frame: DataFrame, part: str, at_once: bool = True) -> DataFrame:
                """A frame that is computed once and read several times; at once, so that its size is known."""
                if self.staging is not None:
                    folder = f"{self.staging.rstrip('/')}/{batch_id}/{part}"
                    frame.write.mode("overwrite").parquet(folder)
                    return frame.sparkSession.read.schema(frame.schema).parquet(folder)
                frame = frame.persist(StorageLevel.MEMORY_AND_DISK)
                used.callback(frame.unpersist)
                if at_once:
                    frame.count()
                return frame

            judged = compact(classify(self.decode(messages), self.config), self.config.registry)
            self._write(kept(judged, "judged", False), batch_id, kept)

    def _write(self, judged: DataFrame, batch_id: str, kept: Callable[..., DataFrame]) -> None:
        days = store.arrival_days(judged, "arrived_at")
        if not days:
            return
        events = to_events(judged, self.config, keep=quarantine.MESSAGE_COLUMNS)
        spark, tables = judged.sparkSession, self.tables
        filters = tables.key_filter(spark, days)
        # The stored keys are listed and read only if a key may be among them.
        doubtful = store.doubtful_keys(
            events, lambda: store.known_keys(tables.events(spark, days)), filters, kept, tables.filtered_days(spark, days)
        )
        doubtful = kept(doubtful, "doubtful")
        # Without a doubtful key, as in most micro-batches, every row is new and the plans stay short.
        all_new = doubtful.isEmpty()
        accepted, conflicts = (events, None) if all_new else store.split_by_key(events, doubtful, batch_id)
        accepted = accepted.withColumn("batch_id", F.lit(batch_id))

        def store_events() -> None:
            if self.event_sink is not None:
                self.event_sink(accepted)
                return
            # The filter learns every key of the batch before any is stored: a crash in between only
            # leaves false positives. Keys of refused copies are stored, filtered and indexed already.
            places = events if all_new else store.new_places(events, doubtful)
            before = []
            if filters is not None:
                before.append(lambda: keyfilter.append(places, "ingest_date", tables.key_filter_path))
            if store.exists(spark, tables.index_path):
                before.append(lambda: store.append_index(places, tables.index_path))
            side_by_side(*before)
            store.append_events(accepted, tables.events_path)
            if store.exists(spark, tables.counts_path):
                stored = events if all_new else store.stored_rows(accepted, events, doubtful, batch_id)
                store.append_counts(stored, batch_id, tables.counts_path)

        def store_failures() -> None:
            refused = quarantine.failure_rows(judged, batch_id, self.config)
            if conflicts is not None:
                refused = refused.unionByName(quarantine.conflict_rows(conflicts, batch_id))
            failed = quarantine.with_unique_ids(kept(refused, "refused", False), kept)
            if self.failure_sink is not None:
                self.failure_sink(failed)
            else:
                store.append_failures(failed, tables.failed_path, days, [batch_id])

        if self.event_sink is None and self.failure_sink is None:
            # Both tables know a repeated batch by themselves, so neither waits for the other.
            side_by_side(store_events, store_failures)
        else:
            # Sinks of the caller are used one after the other.
            store_events()
            store_failures()
        if self.on_counts is not None:
            self.on_counts(batch_id, outcome_counts(judged, conflicts))

    def start(
        self,
        messages: DataFrame,
        checkpoint: str,
        name: str | None = None,
        trigger: dict | None = None,
        metrics: tuple[ProgressMetrics, str] | None = None,
        dedupe_within: str | None = None,
    ) -> StreamingQuery:
        """Ingest a stream. ``trigger`` is that of the stream writer, e.g. ``{"availableNow": True}``.

        With ``metrics`` (a listener added to the session and a table path) every micro-batch's progress,
        with the messages it took (observed as ``intake``), is appended to that table as the stream runs.

        With ``dedupe_within`` (a delay such as ``"1 hour"``) a record whose position came before, within
        that delay of the newest arrival time, is dropped by ``dropDuplicatesWithinWatermark`` before the
        batch: copies across micro-batches never reach the key check. Their number is in the progress
        (``dropped_copies`` of the metrics table). Copies that arrive later still meet the key check.
        """
        # Batches are counted per checkpoint, so its location is part of the batch id.
        origin = hashlib.md5(checkpoint.encode()).hexdigest()[:12]
        if dedupe_within is not None:
            position = [c for c in ("topic", "partition", "offset", "record_key") if c in messages.columns]
            messages = messages.withWatermark("timestamp", dedupe_within).dropDuplicatesWithinWatermark(position)
        if metrics is not None:
            messages = messages.observe("intake", F.count(F.lit(1)).alias("messages"))

        def each(batch: DataFrame, batch_id: int) -> None:
            if metrics is not None:
                metrics[0].flush(batch.sparkSession, metrics[1])
            self.run(batch, f"{origin}-{batch_id}")

        writer = messages.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
        if name:
            writer = writer.queryName(name)
        return writer.trigger(**(trigger or {"processingTime": "10 seconds"})).start()
