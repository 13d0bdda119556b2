"""Event and quarantine tables: key check, append, delete."""

import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass
from datetime import date
from functools import reduce
from operator import or_

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from telemill import schemas
from telemill.operators import keyfilter
from telemill.operators.plan import copies

#: Computes a frame at once and keeps it under a name.
Kept = Callable[[DataFrame, str], DataFrame]

# Among copies of a key the earliest position wins. All other columns follow in the order, so that
# only copies that are equal in every column tie.
_COPY_ORDER = ["topic", "partition", "offset", "ingested_at", "occurred_at", "event_type", "entity_id", "data"]

# The folder of rows without a day.
_NO_DAY = "__HIVE_DEFAULT_PARTITION__"

# A Bloom filter on the key, sized by the keys a file really has.
_LOOKUP_FILTER = {
    "parquet.bloom.filter.enabled#event_id": "true",
    "parquet.bloom.filter.adaptive.enabled": "true",
}


@dataclass(frozen=True)
class Tables:
    """The two tables of a deployment, by path."""

    events_path: str
    failed_path: str

    @property
    def key_filter_path(self) -> str:
        """The Bloom filter of stored keys per day (``keyfilter``)."""
        return f"{self.events_path.rstrip('/')}-key-masks"

    def key_filter(self, spark: SparkSession, days: Sequence[date]) -> DataFrame | None:
        """The filter rows of some days, or None for a table made before the filter existed."""
        return keyfilter.read(spark, self.key_filter_path, list(days))

    def filtered_days(self, spark: SparkSession, days: Sequence[date]) -> list[date] | None:
        """Those of some days that have a filter, by the folders' names; None where the table has no filter."""
        return keyfilter.filtered_days(spark, self.key_filter_path, list(days))

    @property
    def counts_path(self) -> str:
        """Rows stored per arrival day and append (``append_counts``)."""
        return f"{self.events_path.rstrip('/')}-day-counts"

    def day_counts(self, spark: SparkSession) -> list[tuple[date, int]] | None:
        """Stored rows per day, newest first, from the count table; None for a table without one.

        The counts never exceed the rows stored: an append writes its count after its events, a
        delete its negative count before it rewrites, and a repeated append counts once.
        """
        if not exists(spark, self.counts_path):
            return None
        counts = spark.read.schema(_COUNT_ROW).parquet(self.counts_path)
        per_append = counts.groupBy("ingest_date", "batch_id").agg(F.max("n").alias("n"))
        rows = per_append.groupBy("ingest_date").agg(F.sum("n").alias("n")).collect()
        return sorted(((r["ingest_date"], r["n"]) for r in rows), key=lambda r: (r[0] is not None, r[0]), reverse=True)

    @property
    def index_path(self) -> str:
        """Where each id's day and domain are found, by a prefix of the id (``append_index``)."""
        return f"{self.events_path.rstrip('/')}-id-index"

    def lookup(self, spark: SparkSession, event_id: str) -> DataFrame:
        """The rows with this id, from the folders the index names; the whole table without an index.

        One bucket of the index is opened, then only the day and domain folders of the id, so the
        files read do not grow with the history.
        """
        bucket = f"{self.index_path}/bucket={_bucket_of(event_id)}"
        if not exists(spark, self.index_path):
            return self.events(spark).where(F.col("event_id") == event_id)
        if not exists(spark, bucket):
            return spark.createDataFrame([], schemas.EVENTS)
        places = (
            spark.read.schema(_INDEX_ROW).parquet(bucket)
            .where(F.col("event_id") == event_id)
            .select("ingest_date", "domain")
            .distinct()
            .collect()
        )
        if not places:
            return spark.createDataFrame([], schemas.EVENTS)
        # The day folders are named here; Spark prunes their domain folders by the predicate.
        part = self.events(spark, sorted({day for day, _ in places}, key=str))
        domains = F.col("domain").isin([d for _, d in places if d is not None])
        if any(d is None for _, d in places):
            domains = domains | F.col("domain").isNull()
        return part.where(domains & (F.col("event_id") == event_id))

    @classmethod
    def under(cls, root: str) -> "Tables":
        return cls(f"{root}/events", f"{root}/failed_messages")

    def create(self, spark: SparkSession) -> "Tables":
        """Create empty tables where there are none; existing ones are left alone.

        The key filter is created only with a new event table: one made before would lack its keys.
        """
        if not exists(spark, self.events_path):
            keyfilter.create(spark, self.key_filter_path)
            spark.createDataFrame([], _INDEX_ROW).write.mode("ignore").partitionBy("bucket").parquet(self.index_path)
            spark.createDataFrame([], _COUNT_ROW).write.mode("ignore").parquet(self.counts_path)
        for path, schema, partitions in (
            (self.events_path, schemas.EVENTS, schemas.EVENT_PARTITIONS),
            (self.failed_path, schemas.FAILED_MESSAGES, schemas.FAILED_PARTITIONS),
        ):
            spark.createDataFrame([], schema).write.mode("ignore").partitionBy(*partitions).parquet(path)
        return self

    def events(self, spark: SparkSession, days: Sequence[date] | None = None) -> DataFrame:
        """The event table, or its part of some arrival days; only their folders are listed then."""
        return _read(spark, self.events_path, schemas.EVENTS, "ingest_date", days)

    def newest(
        self, spark: SparkSession, rows: int, where: Column | None = None, until: date | None = None
    ) -> DataFrame:
        """Events of the newest days, as many days as it takes to hold ``rows`` of them (``where`` counts).

        The days come from the folders' names, newest first, doubling: a page opens the files of its own
        days, not of the whole history. ``until`` leaves out later days.
        """
        days = [d for d in _stored_days(spark, self.events_path) if until is None or (d is not None and d <= until)]
        counts = self.day_counts(spark) if where is None else None
        if counts is not None:
            # Counted days, newest first, until they hold the rows; an uncounted stored day is read too.
            counted = dict(counts)
            taken, held = 0, 0
            for day in days:
                taken += 1
                held += counted.get(day, 0)
                if held >= rows and day in counted:
                    break
            return self.events(spark, days[:taken])
        taken = 1
        while True:
            part = self.events(spark, days[:taken])
            found = part if where is None else part.where(where)
            if taken >= len(days) or found.limit(rows).count() >= rows:
                return found
            taken *= 2

    def failed(self, spark: SparkSession, days: Sequence[date] | None = None) -> DataFrame:
        return _read(spark, self.failed_path, schemas.FAILED_MESSAGES, "created_date", days)


#: Index buckets: the first characters of the id (hex text), 256 folders.
_BUCKET_CHARS = 2

_INDEX_ROW = T.StructType(
    [
        T.StructField("event_id", T.StringType()),
        T.StructField("ingest_date", T.DateType()),
        T.StructField("domain", T.StringType()),
        T.StructField("bucket", T.StringType()),
    ]
)


_COUNT_ROW = T.StructType(
    [
        T.StructField("ingest_date", T.DateType()),
        T.StructField("batch_id", T.StringType()),
        T.StructField("n", T.LongType()),
    ]
)


def append_counts(stored: DataFrame, batch_id: str, path: str) -> None:
    """Count the rows a batch has stored (``stored_rows``), per day; call it after the events are written.

    A crash before it leaves the day undercounted, which only makes a page read one day more. Counting the
    batch, not the table, keeps the files read by an append independent of the history.
    """
    counted = stored.groupBy("ingest_date").agg(F.count("*").alias("n"))
    counted.select("ingest_date", F.lit(batch_id).alias("batch_id"), "n").coalesce(1).write.mode("append").parquet(
        path
    )


def _bucket_of(event_id: str) -> str:
    return (event_id or "")[:_BUCKET_CHARS].lower() or "_"


def append_index(places: DataFrame, path: str) -> None:
    """Add the ids of a batch (``new_places``) to the index; call it before the events are written.

    An id indexed but not stored (a crash in between, a refused copy) costs one empty look; an id
    stored but not indexed cannot happen. Rows are sorted by id inside a bucket, so a lookup reads
    the row groups whose id range holds it.
    """
    bucket = F.coalesce(F.nullif(F.lower(F.substring("event_id", 1, _BUCKET_CHARS)), F.lit("")), F.lit("_"))
    (
        places.select("event_id", "ingest_date", "domain", bucket.alias("bucket"))
        .repartition("bucket")
        .sortWithinPartitions("bucket", "event_id")
        .write.mode("append")
        .option("mapreduce.fileoutputcommitter.algorithm.version", "2")
        .partitionBy("bucket")
        .parquet(path)
    )


def _read(spark: SparkSession, root: str, schema: T.StructType, key: str, days: Sequence[date] | None) -> DataFrame:
    reader = spark.read.schema(schema)
    if days is None:
        return reader.parquet(root)
    # One listing of the table's folders, whatever the number of days asked for.
    stored = set(_stored_days(spark, root))
    found = [f"{root}/{key}={day or _NO_DAY}" for day in dict.fromkeys(days) if day in stored]
    return reader.option("basePath", root).parquet(*found) if found else _nothing(spark, schema)


def _nothing(spark: SparkSession, schema: T.StructType) -> DataFrame:
    """No rows, in a way the optimizer sees: joins with it vanish from the plan."""
    return spark.createDataFrame([], schema).where(F.lit(False))


def _folder(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), path


def exists(spark: SparkSession, folder: str) -> bool:
    files, path = _folder(spark, folder)
    return files.exists(path)


def _stored_days(spark: SparkSession, root: str) -> list[date | None]:
    """The days of a table's folders, newest first, rows without a day last."""
    files, path = _folder(spark, root)
    values = [s.getPath().getName().partition("=")[2] for s in files.listStatus(path) if s.isDirectory()]
    days = sorted((date.fromisoformat(v) for v in values if v and v != _NO_DAY), reverse=True)
    return [*days, None] if _NO_DAY in values else days


def create_catalog_tables(spark: SparkSession, database: str, tables: Tables) -> None:
    """Declare both tables in the catalog, idempotently. Layout takes the place of indexes."""
    for name, path, schema, partitions in (
        ("events", tables.events_path, schemas.EVENTS, schemas.EVENT_PARTITIONS),
        ("failed_messages", tables.failed_path, schemas.FAILED_MESSAGES, schemas.FAILED_PARTITIONS),
    ):
        columns = ", ".join(
            f"`{f.name}` {f.dataType.simpleString()}{'' if f.nullable else ' NOT NULL'}" for f in schema
        )
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {database}.{name} ({columns}) USING parquet "
            f"PARTITIONED BY ({', '.join(partitions)}) LOCATION '{path}'"
        )


def _order(batch: DataFrame) -> list[str]:
    return [c for c in _COPY_ORDER if c in batch.columns] + sorted({*batch.columns} - {*_COPY_ORDER})


def first_copies(batch: DataFrame) -> DataFrame:
    """One row per event_id, the earliest.

    Spark keeps the first row per key already before the shuffle, so a key that holds a large part
    of the batch sends one row per task, not all its copies.
    """
    earliest = Window.partitionBy("event_id").orderBy(*_order(batch))
    return batch.withColumn("_copy", F.row_number().over(earliest)).where("_copy = 1").drop("_copy")


def later_copies(batch: DataFrame) -> DataFrame:
    """Every row that ``first_copies`` leaves out.

    Equal copies are counted before the shuffle and written out again, one less of the winner's: no
    task sees all copies of a hot key, and nothing depends on how the rows are dealt out.
    """
    content = F.md5(F.to_json(F.struct(*_order(batch))))
    marked = batch.withColumn("_content", content)
    winners = first_copies(marked).select("event_id", F.col("_content").alias("_first"))
    counted = marked.groupBy(*marked.columns).agg(F.count("*").alias("_n")).join(winners, "event_id")
    lost = counted.withColumn("_n", F.col("_n") - (F.col("_content") == F.col("_first")).cast("int"))
    return copies(lost, "_n").select(*batch.columns)


def known_keys(events: DataFrame) -> DataFrame:
    """Stored keys with the batch that stored them.

    Give it the part of the table a batch can touch (``Tables.events(spark, days)``): ``ingest_date``
    comes from the record's arrival time, which belongs to its position, so a record that comes again
    lands in the same day, and the rest of the history need not be listed or read.
    """
    return events.select("event_id", F.col("batch_id").alias("_stored_by"))


def arrival_days(records: DataFrame, column: str) -> list[date | None]:
    """The distinct arrival days of a batch, None among them; the calendar bounds them."""
    return sorted((row[0] for row in records.select(F.to_date(column)).distinct().collect()), key=str)


def doubtful_keys(
    batch: DataFrame,
    known: DataFrame | Callable[[], DataFrame],
    filters: DataFrame | None = None,
    kept: Kept | None = None,
    filtered: Sequence[date] | None = None,
) -> DataFrame:
    """Keys that need a verdict: those that occur twice in the batch, and those that are stored.

    Only keys are shuffled for it. With the key filter of the batch's days (``Tables.key_filter``), only
    keys that may be stored meet the stored keys, and those few are sent to the scan of stored keys, which
    is then not shuffled. Keep the result when it is used more than once. ``kept`` computes a frame at once
    and keeps it, so that Spark knows its size when it plans the next join; if no key may be stored then,
    ``known`` is not used, and a function that makes it is not called. ``filtered`` are the filter's days.
    """
    counted = batch.groupBy("event_id").agg(F.count("*").alias("_rows"))
    of = known if callable(known) else lambda: known
    if filters is None:
        return counted.join(of(), "event_id", "left").where("_rows > 1 OR _stored_by IS NOT NULL").drop("_rows")
    repeated = counted.where("_rows > 1").select("event_id")
    none_stored = repeated.withColumn("_stored_by", F.lit(None).cast("string"))
    if kept and filtered is not None and not filtered:
        return none_stored
    keys = batch.select("event_id", F.col("ingest_date").alias("day"))
    maybe = keyfilter.maybe_stored(keys, filters, filtered).select("event_id").distinct()
    if kept:
        maybe = kept(maybe, "maybe-stored")
        if maybe.isEmpty():
            return none_stored
    stored = of().join(maybe, "event_id", "left_semi")
    return repeated.join(kept(stored, "stored") if kept else stored, "event_id", "full_outer")


def new_places(batch: DataFrame, doubtful: DataFrame) -> DataFrame:
    """``event_id``, ``ingest_date``, ``domain`` of the batch's rows whose key is not stored, each once.

    Keys outside ``doubtful`` occur once, so only the copied ones are made distinct.
    """
    places = batch.select("event_id", "ingest_date", "domain")
    fresh = doubtful.where(F.col("_stored_by").isNull()).select("event_id")
    copied = places.join(fresh, "event_id", "left_semi").distinct()
    return places.join(doubtful, "event_id", "left_anti").unionByName(copied)


def stored_rows(accepted: DataFrame, batch: DataFrame, doubtful: DataFrame, batch_id: str) -> DataFrame:
    """``event_id``, ``ingest_date`` of what a batch has stored: the accepted rows, and those an earlier,
    broken run of the same batch stored."""
    mine = doubtful.where(F.col("_stored_by") == batch_id).select("event_id")
    earlier = first_copies(batch.join(mine, "event_id", "left_semi"))
    return accepted.select("event_id", "ingest_date").unionByName(earlier.select("event_id", "ingest_date"))


def split_by_key(batch: DataFrame, doubtful: DataFrame, batch_id: str) -> tuple[DataFrame, DataFrame]:
    """Rows to append and rows that violate the primary key, by the verdict on the doubtful keys.

    All other rows pass as they are. A key stored by this very batch means the batch is being
    repeated after a crash: such a row is in neither part.
    """
    plain = batch.join(doubtful, "event_id", "left_anti")
    copied = batch.join(doubtful, "event_id", "left_semi")
    judged = first_copies(copied).join(doubtful, "event_id")
    fresh = judged.where(F.col("_stored_by").isNull()).drop("_stored_by")
    taken = judged.where(F.col("_stored_by") != batch_id).drop("_stored_by")
    return plain.unionByName(fresh), taken.unionByName(later_copies(copied))


def check_keys(
    batch: DataFrame, known: DataFrame, batch_id: str, filters: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """Both steps at once, for a caller that reads the parts once."""
    return split_by_key(batch, doubtful_keys(batch, known, filters), batch_id)


def append_events(events: DataFrame, path: str) -> None:
    """Append events in the table's layout."""
    _write_events(events.select(*schemas.EVENTS.fieldNames()), path, "append")


def _write_events(events: DataFrame, path: str, mode: str) -> None:
    """Write events; ``overwrite`` replaces only the partitions that occur in the rows.

    Rebalancing gathers a partition's rows into few files and splits a partition that is too large
    for one task. Rows are in page order inside a file, so time ranges skip row groups; the Bloom
    filter does the same for point lookups by id.
    """
    (
        events.hint("rebalance", *schemas.EVENT_PARTITIONS)
        .sortWithinPartitions(*schemas.EVENT_PARTITIONS, F.desc("ingested_at"), F.desc("event_id"))
        .write.mode(mode)
        .option("partitionOverwriteMode", "dynamic")
        .options(**_LOOKUP_FILTER)
        .partitionBy(*schemas.EVENT_PARTITIONS)
        .parquet(path)
    )


def append_failures(
    failed: DataFrame, path: str, days: Sequence[date] | None = None, batches: Sequence[str] | None = None
) -> None:
    """Append quarantine rows, leaving out those a repeated batch has written before.

    ``days`` are the rows' days, ``batches`` their batches; they are gathered from the rows when not given. An id derives from its
    batch, so only stored rows of the same batches are compared: their ids are gathered first, and when
    they are few, as they are unless a batch is repeated, the rows are not shuffled to meet them.
    """
    days = arrival_days(failed, "created_date") if days is None else days
    table = _read(failed.sparkSession, path, schemas.FAILED_MESSAGES, "created_date", days)
    if batches is None:
        batches = [row[0] for row in failed.select("batch_id").distinct().collect()]
    with _at_once(table.where(F.col("batch_id").isin(batches)).select("id")) as stored:
        fresh = failed if stored.isEmpty() else failed.join(stored, "id", "left_anti")
        (
            fresh.select(*schemas.FAILED_MESSAGES.fieldNames())
            .hint("rebalance", *schemas.FAILED_PARTITIONS)
            .sortWithinPartitions(*schemas.FAILED_PARTITIONS, "created_at")
            .write.mode("append")
            .partitionBy(*schemas.FAILED_PARTITIONS)
            .parquet(path)
        )


@contextmanager
def _at_once(frame: DataFrame) -> Iterator[DataFrame]:
    """The frame computed now and kept while in use, so that Spark plans joins with its real size."""
    frame = frame.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        frame.count()
        yield frame
    finally:
        frame.unpersist()


def without_ids(events: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows whose event_id is not listed; ids that do not occur change nothing."""
    return events.join(ids.select("event_id").distinct(), "event_id", "left_anti")


def delete_events(spark: SparkSession, tables: Tables, ids: DataFrame) -> int:
    """Delete events by id; returns how many partitions were rewritten.

    Parquet has no row delete, so the partitions that hold a listed id are written anew and all the
    others stay untouched.
    """
    with _at_once(ids.select("event_id").distinct()) as listed:
        return _delete_listed(spark, tables, listed)


def _delete_listed(spark: SparkSession, tables: Tables, listed: DataFrame) -> int:
    events = tables.events(spark)
    touched = (
        events.select("event_id", *schemas.EVENT_PARTITIONS)
        .join(listed, "event_id", "left_semi")
        .select(*schemas.EVENT_PARTITIONS)
        .distinct()
        .collect()
    )
    if not touched:
        return 0
    if exists(spark, tables.counts_path):
        # Written before the rewrite: a crash in between leaves an undercount, never an overcount.
        removed = events.join(listed, "event_id", "left_semi").groupBy("ingest_date").agg((-F.count("*")).alias("n"))
        # A retried delete writes its negative count again: a further undercount, still safe.
        tag = F.lit(f"delete-{uuid.uuid4().hex}")
        removed.select("ingest_date", tag.alias("batch_id"), "n").write.mode("append").parquet(tables.counts_path)
    # Days times domains bound the touched partitions, so they fit a literal predicate, which prunes
    # the scan to exactly these partitions.
    days_of: dict[str, list[date]] = {}
    for day, domain in touched:
        days_of.setdefault(domain, []).append(day)
    here = reduce(
        or_,
        [(F.col("domain") == F.lit(d)) & F.col("ingest_date").isin(days) for d, days in days_of.items()],
    )
    kept = without_ids(events.where(here), listed).select(*events.columns)
    remaining = {tuple(row) for row in kept.select(*schemas.EVENT_PARTITIONS).distinct().collect()}
    if remaining:
        _write_events(kept, tables.events_path, "overwrite")
    # A partition with no row left is not replaced by the write above: its folder goes, without a job.
    for day, domain in touched:
        if (day, domain) not in remaining:
            files, path = _folder(spark, f"{tables.events_path}/ingest_date={day or _NO_DAY}/domain={domain}")
            files.delete(path, True)
    return len(touched)
