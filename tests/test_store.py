"""Tables: keys, replays, pages, deletes."""

from datetime import datetime, timedelta

import pytest
from helpers import ARRIVED, climate, energy, finance, message, records
from pyspark.sql import functions as F

from telemill.functions import InvalidCursor
from telemill.operators import keyfilter, reads, store
from telemill.operators.store import Tables
from telemill.streaming import IngestJob


@pytest.fixture
def tables(spark, tmp_path):
    return Tables.under(str(tmp_path)).create(spark)


def spread_over_days(spark, values, days=3, per_second=4):
    """Records whose arrival times repeat, so that pages have ties."""
    frame = records(spark, values)
    shift = F.make_dt_interval(days=F.col("offset") % days, secs=F.floor(F.col("offset") / per_second))
    return frame.withColumn("timestamp", F.col("timestamp") + shift)


def ids(frame):
    return [r["event_id"] for r in frame.select("event_id").collect()]


def test_create_is_idempotent(spark, tables):
    IngestJob(tables).run(records(spark, [energy()]), "b1")
    tables.create(spark)
    assert tables.events(spark).count() == 1


def test_round_trip_by_id(spark, tables):
    IngestJob(tables).run(records(spark, [energy(), finance()]), "b1")
    event = tables.events(spark).where("domain = 'energy_meter'").first()
    assert reads.get_event(tables.events(spark), event["event_id"]).first() == event
    with pytest.raises(reads.EventNotFound, match="event not found"):
        reads.require_event(tables.events(spark), "nope")


def test_duplicate_key_goes_to_quarantine(spark, tables):
    once = records(spark, [energy()])
    IngestJob(tables).run(once.union(once), "b1")
    assert tables.events(spark).count() == 1
    failed = tables.failed(spark).collect()
    assert [r["stage"] for r in failed] == ["store"]
    assert failed[0]["raw_value"] == energy()
    IngestJob(tables).run(once, "b2")
    assert tables.events(spark).count() == 1
    assert tables.failed(spark).where("stage = 'store'").count() == 2


def test_repeated_batch_adds_nothing(spark, tables):
    batch = spread_over_days(spark, [energy(), finance(), "junk", climate(0), message("x", {})])
    for _ in range(2):
        IngestJob(tables).run(batch, "b1")
    assert (tables.events(spark).count(), tables.failed(spark).count()) == (2, 3)


def test_batch_repeated_after_a_crash_between_the_sinks(spark, tables):
    batch = spread_over_days(spark, [energy(), "junk"])

    def down(_):
        raise OSError("down")

    with pytest.raises(OSError):
        IngestJob(tables, failure_sink=down).run(batch, "b1")
    assert tables.events(spark).count() == 1
    IngestJob(tables).run(batch, "b1")
    assert tables.events(spark).count() == 1
    assert [r["stage"] for r in tables.failed(spark).collect()] == ["process"]


def test_backfill_staged_as_a_table(spark, tables, tmp_path):
    job = IngestJob(tables, staging=str(tmp_path / "staging"))
    for _ in range(2):
        job.run(spread_over_days(spark, [energy(), "junk", finance()]), "b1")
    assert (tables.events(spark).count(), tables.failed(spark).count()) == (2, 1)


def test_hot_key_copies_are_split_exactly(spark):
    rows = spark.range(0, 6000, 1, 12).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id"))).alias("event_id"),
        F.lit("t").alias("topic"), F.lit(0).alias("partition"), F.lit(7).cast("bigint").alias("offset"),
        F.lit(ARRIVED).alias("ingested_at"), F.lit(ARRIVED).alias("occurred_at"), F.lit("e").alias("event_type"),
        F.lit("d").alias("entity_id"), (F.col("id") % 2).cast("string").alias("data"),
    )
    first, later = store.first_copies(rows), store.later_copies(rows)
    assert first.count() == 4001 and later.count() == 1999
    assert first.where("event_id = 'hot'").first()["data"] == "0"
    both = first.unionByName(later).groupBy("event_id", "data").count()
    assert both.exceptAll(rows.groupBy("event_id", "data").count()).isEmpty()


def test_every_failure_of_one_position_has_its_own_id(spark, tables):
    good, bad = records(spark, [energy()]), records(spark, ["junk"], start=5)
    other = records(spark, ["other junk"], start=5)
    batch = good.union(good).union(good).union(bad).union(bad).union(other)
    for _ in range(2):
        IngestJob(tables).run(batch, "b1")
        failed = tables.failed(spark).collect()
        assert sorted(r["stage"] for r in failed) == ["process"] * 3 + ["store"] * 2
        assert len({r["id"] for r in failed}) == 5
    IngestJob(tables).run(good.union(good).union(good), "b2")
    failed = tables.failed(spark).where("stage = 'store'").collect()
    assert len(failed) == len({r["id"] for r in failed}) == 5


def test_differing_copies_keep_the_earliest_and_lose_none(spark, tables):
    copies = [energy(power=float(i % 5 + 1)) for i in range(40)]
    frame = records(spark, copies).withColumn("offset", F.lit(3).cast("bigint")).repartition(7)
    IngestJob(tables).run(frame, "b1")
    stored = tables.events(spark).collect()
    refused = [r["raw_value"] for r in tables.failed(spark).collect()]
    assert len(stored) == 1 and len(refused) == 39
    assert sorted([*refused, energy(power=1.0)]) == sorted(copies)


def test_a_batch_lists_and_reads_only_its_days(spark, tables):
    IngestJob(tables).run(spread_over_days(spark, [energy()] * 9, days=3), "b1")
    days = store.arrival_days(records(spark, [energy()]), "timestamp")
    assert [d.isoformat() for d in days] == ["2024-01-05"]
    part = tables.events(spark, days)
    assert all("ingest_date=2024-01-05" in f for f in part.inputFiles())
    assert part.columns == tables.events(spark).columns and part.count() == 3
    assert tables.events(spark, [datetime(1999, 1, 1).date()]).isEmpty()


def test_many_days_cost_one_listing(spark, tables, monkeypatch):
    """2,000 asked-for days of which three are stored: one listing of the table, no call per day."""
    IngestJob(tables).run(spread_over_days(spark, [energy()] * 9, days=3), "b1")
    listings = []
    listed = store._stored_days
    monkeypatch.setattr(store, "_stored_days", lambda *a: listings.append(a) or listed(*a))
    start = datetime(2019, 1, 1).date()
    days = [start + timedelta(days=k) for k in range(2000)]
    assert "2024-01-05" in {d.isoformat() for d in days}
    part = tables.events(spark, days)
    assert len(listings) == 1 and part.count() == 9
    assert {f.split("ingest_date=")[1][:10] for f in part.inputFiles()} == {"2024-01-05", "2024-01-06", "2024-01-07"}


def test_newest_days_are_found_by_name(spark, tables):
    assert tables.newest(spark, 5).isEmpty()
    IngestJob(tables).run(spread_over_days(spark, [energy()] * 9, days=3), "b1")

    def days(frame):
        return sorted({str(r[0]) for r in frame.select("ingest_date").collect()})

    assert days(tables.newest(spark, 3)) == ["2024-01-07"]
    assert days(tables.newest(spark, 4)) == ["2024-01-06", "2024-01-07"]
    assert tables.newest(spark, 100).count() == 9
    assert days(tables.newest(spark, 1, until=datetime(2024, 1, 6).date())) == ["2024-01-06"]


def walk(events, size):
    found, cursor = [], None
    while True:
        page = reads.list_page(events, size, cursor)
        found += ids(page.items)
        if not page.has_more:
            assert page.next_cursor is None
            return found
        cursor = page.next_cursor


def test_pages_cover_everything_once_with_ties(spark, tables):
    IngestJob(tables).run(spread_over_days(spark, [energy()] * 23), "b1")
    events = tables.events(spark)
    expected = [r["event_id"] for r in sorted(events.collect(), key=lambda r: (r["ingested_at"], r["event_id"]), reverse=True)]
    assert walk(events, 5) == expected
    exported = reads.page_numbers(events, 5).orderBy("position").collect()
    assert [r["event_id"] for r in exported] == expected
    assert [r["page"] for r in exported] == [i // 5 for i in range(23)]


def test_default_page_and_empty_table(spark, tables):
    empty = reads.list_page(tables.events(spark))
    assert empty.items.isEmpty() and not empty.has_more and empty.next_cursor is None
    IngestJob(tables).run(spread_over_days(spark, [energy()] * 25), "b1")
    page = reads.list_page(tables.events(spark))
    assert page.items.count() == 20 and page.has_more
    with pytest.raises(InvalidCursor):
        reads.list_page(tables.events(spark), cursor="not-valid-base64!!")


def test_delete_rewrites_only_touched_partitions(spark, tables, tmp_path):
    IngestJob(tables).run(spread_over_days(spark, [energy()] * 9 + [finance()]), "b1")
    events = tables.events(spark).collect()
    victims = [r["event_id"] for r in events if r["domain"] == "financial_stream"] + [
        next(r["event_id"] for r in events if r["domain"] == "energy_meter")
    ]
    listed = spark.createDataFrame([(v,) for v in [*victims, "absent"]], "event_id string")
    files = {p: p.stat().st_mtime_ns for p in (tmp_path / "events").rglob("*.parquet")}
    assert store.delete_events(spark, tables, listed) == 2
    assert sorted(ids(tables.events(spark))) == sorted({r["event_id"] for r in events} - set(victims))
    kept = {p: t for p, t in files.items() if p.exists() and p.stat().st_mtime_ns == t}
    assert len(kept) == len({p.parent for p in files}) - 2
    assert store.delete_events(spark, tables, listed) == 0


def test_unreadable_rows_are_named_and_can_fail_the_query(spark, tables):
    IngestJob(tables).run(records(spark, [energy(), finance()]), "b1")
    events = tables.events(spark)
    assert reads.require_readable(events).count() == 2
    broken = events.withColumn("data", F.when(F.col("domain") == "energy_meter", "{").otherwise(F.col("data")))
    assert {r["read_error"] for r in reads.read_errors(broken).collect()} == {None, "payload cannot be decoded"}
    with pytest.raises(Exception, match="payload cannot be decoded"):
        reads.require_readable(broken).collect()


def test_read_back_is_strict(spark, tables):
    IngestJob(tables).run(records(spark, [energy(), finance()]), "b1")
    events = tables.events(spark).where("domain = 'financial_stream'")
    text = F.col("data")
    cases = [
        ("data", text, None),
        ("data", F.concat(text, F.lit(" junk")), "payload cannot be decoded"),
        ("data", F.concat(text, F.lit(","), text), "payload cannot be decoded"),
        ("data", F.regexp_replace(text, '"currency":"[^"]*"', '"currency":5'), "payload cannot be decoded"),
        ("event_type", F.lit("other"), None),
        ("event_id", F.replace("event_id", F.lit("-")), None),
        ("event_id", F.concat(F.lit("urn:uuid:"), "event_id"), None),
        ("event_id", F.concat(F.lit("{"), "event_id", F.lit("}")), None),
        ("event_id", F.concat("event_id", F.lit("0")), "invalid event UUID"),
    ]
    for column, value, expected in cases:
        assert reads.read_errors(events.withColumn(column, value)).first()["read_error"] == expected
    unknown = events.withColumns({"event_type": F.lit("other"), "data": F.lit('{"data": 5}')})
    assert reads.read_errors(unknown).first()["read_error"] == "payload cannot be decoded"


def test_catalog_tables_enforce_the_declared_columns(spark, tables):
    spark.sql("CREATE DATABASE IF NOT EXISTS telemill_test")
    for _ in range(2):
        store.create_catalog_tables(spark, "telemill_test", tables)
    assert spark.table("telemill_test.events").schema.fieldNames() == tables.events(spark).schema.fieldNames()
    spark.sql("DROP DATABASE telemill_test CASCADE")


def test_keyset_predicate_matches_tuple_order(spark):
    base = datetime(2024, 1, 1)
    rows = [(base + timedelta(seconds=s), i) for s in range(4) for i in "abc"]
    frame = spark.createDataFrame(rows, "ingested_at timestamp_ntz, event_id string")
    for t, i in rows:
        found = {tuple(r) for r in frame.where(reads.before(t, i)).collect()}
        assert found == {r for r in rows if r < (t, i)}


def test_key_filter_misses_no_stored_key(spark, tables):
    """Every stored key passes the filter; of 20,000 fresh keys of a stored day almost none do."""
    IngestJob(tables).run(spread_over_days(spark, [energy(), finance()] * 20, days=3), "b1")
    stored = tables.events(spark).select("event_id", F.col("ingest_date").alias("day"))
    days = [r[0] for r in stored.select("day").distinct().collect()]
    filters = tables.key_filter(spark, days)
    assert filters is not None and keyfilter.maybe_stored(stored, filters).count() == stored.count() == 40
    fresh = spark.range(20000).select(
        F.concat(F.lit("fresh-"), F.col("id").cast("string")).alias("event_id"), F.lit(days[0]).alias("day")
    )
    assert keyfilter.maybe_stored(fresh, filters).count() <= 2
    none_day = spark.createDataFrame([("k", None)], "event_id string, day date")
    assert keyfilter.maybe_stored(none_day, filters).count() == 0


def test_key_filter_is_absent_for_an_older_table(spark, tables, tmp_path):
    """A table made before the filter existed gets none, and the check compares all keys."""
    IngestJob(tables).run(records(spark, [energy()] * 3), "b1")
    older = Tables(tables.events_path, tables.failed_path)
    import shutil

    shutil.rmtree(older.key_filter_path)
    assert older.key_filter(spark, store.arrival_days(records(spark, [energy()]), "timestamp")) is None
    IngestJob(older).run(records(spark, [energy()] * 3), "b2")
    assert older.events(spark).count() == 3 and older.failed(spark).count() == 3


def test_only_keys_the_filter_passes_meet_the_stored_keys(spark, tables):
    IngestJob(tables).run(records(spark, [energy()] * 3), "b1")
    events = tables.events(spark)
    days = [r[0] for r in events.select("ingest_date").distinct().collect()]
    doubtful = store.doubtful_keys(events.drop("batch_id"), store.known_keys(events), tables.key_filter(spark, days))
    text = doubtful._jdf.queryExecution().executedPlan().toString()
    assert "LeftSemi" in text and "CartesianProduct" not in text
    assert doubtful.count() == 3


def test_lookup_opens_one_bucket_and_the_days_of_the_id(spark, tables):
    IngestJob(tables).run(spread_over_days(spark, [energy(), finance()] * 6, days=3), "b1")
    events = tables.events(spark)
    for row in events.select("event_id", "ingest_date", "domain").collect():
        found = tables.lookup(spark, row["event_id"])
        assert [r["event_id"] for r in found.collect()] == [row["event_id"]]
        assert all(f"ingest_date={row['ingest_date']}/" in f for f in found.inputFiles())
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters" in plan and "domain" in plan.split("PartitionFilters")[1][:300]
    assert tables.lookup(spark, "no-such-id").isEmpty() and tables.lookup(spark, "").isEmpty()
    older = Tables(tables.events_path + "-none", tables.failed_path).create(spark)
    assert older.lookup(spark, "x").isEmpty()


def test_day_counts_follow_appends_repeats_and_deletes(spark, tables):
    """Counts equal the stored rows per day after an append, its repeat and a delete; a page reads
    only the newest days it needs, without a counting job over the events."""
    job = IngestJob(tables)
    job.run(spread_over_days(spark, [energy(), finance()] * 6, days=3), "b1")
    job.run(spread_over_days(spark, [energy(), finance()] * 6, days=3), "b1")
    actual = lambda: sorted(
        (r[0], r[1]) for r in tables.events(spark).groupBy("ingest_date").count().collect()
    )
    assert sorted(tables.day_counts(spark)) == actual()
    gone = tables.events(spark).orderBy("event_id").limit(2).select("event_id")
    store.delete_events(spark, tables, gone)
    assert sorted(tables.day_counts(spark)) == actual()
    newest = tables.newest(spark, 3)
    assert {f.split("ingest_date=")[1][:10] for f in newest.inputFiles()} == {str(actual()[-1][0])}
    assert newest.count() == actual()[-1][1]


def test_a_replayed_batch_adds_nothing_to_filter_and_index(spark, tables):
    """A key is one row of the filter and of the index; stored keys that come again add none."""
    batch = spread_over_days(spark, [energy(), finance()] * 20, days=3)
    IngestJob(tables).run(batch, "b1")
    IngestJob(tables).run(batch, "b2")
    index = spark.read.parquet(tables.index_path)
    days = [r[0] for r in tables.events(spark).select("ingest_date").distinct().collect()]
    assert index.count() == index.select("event_id").distinct().count() == 40
    assert tables.key_filter(spark, days).count() <= 40
    assert tables.events(spark).count() == 40 and tables.failed(spark).count() == 40


def test_copies_in_a_batch_are_filtered_and_indexed_once(spark, tables):
    """Copies of one position are stored once; a second run of a broken batch counts what the first stored."""
    twice = records(spark, [energy()] * 3).unionByName(records(spark, [energy()] * 3))
    IngestJob(tables).run(twice, "b1")
    assert spark.read.parquet(tables.index_path).count() == 3
    assert [n for _, n in tables.day_counts(spark)] == [3]
    IngestJob(tables).run(twice, "b1")
    assert [n for _, n in tables.day_counts(spark)] == [3]
    assert (tables.events(spark).count(), tables.failed(spark).count()) == (3, 3)
