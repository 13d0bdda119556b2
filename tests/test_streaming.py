"""Streams give the tables that a batch gives, and stop rather than lose messages."""

import os

import pytest
from helpers import climate, energy, finance, message, records
from pyspark.errors import AnalysisException
from pyspark.sql import Observation
from pyspark.sql import functions as F

from telemill.operators.decode import decode
from telemill.operators.quarantine import dlq_records
from telemill.operators.store import Tables
from telemill.operators.transform import classify
from telemill.sources import (
    KafkaConfig, message_files, message_stream_files, replay_documents, replay_lines,
)
from telemill.streaming import IngestJob, observe_outcomes, with_fallback
from telemill.streaming.ingest import side_by_side

VALUES = [energy(), finance(), climate(), "junk", climate(0), message("x", {}), message("energy_meter", {}, device="")] * 5
NOW = {"availableNow": True}


def write_topic(spark, path, values=VALUES, start=0, files=4):
    frame = records(spark, values, start=start).repartition(files)
    frame.write.mode("append").option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").json(path)


def contents(spark, tables):
    events = tables.events(spark).select("event_id", "domain", "data", "occurred_at", "ingested_at").collect()
    failed = tables.failed(spark).select("stage", "offset", "error", "raw_value", "created_at").collect()
    return sorted(map(tuple, events)), sorted(map(tuple, failed))


def test_stream_equals_batch_and_restart_adds_nothing(spark, tmp_path):
    topic, checkpoint = str(tmp_path / "topic"), str(tmp_path / "checkpoint")
    write_topic(spark, topic)
    streamed, batch = Tables.under(str(tmp_path / "s")).create(spark), Tables.under(str(tmp_path / "b")).create(spark)
    IngestJob(batch).run(message_files(spark, topic), "b1")
    job = IngestJob(streamed)
    for _ in range(2):
        job.start(message_stream_files(spark, topic, 2), checkpoint, trigger=NOW).awaitTermination()
        assert contents(spark, streamed) == contents(spark, batch)
    events, failed = contents(spark, streamed)
    assert (len(events), len(failed)) == (15, 20)
    write_topic(spark, topic, [energy()], start=1000)
    job.start(message_stream_files(spark, topic), checkpoint, trigger=NOW).awaitTermination()
    assert streamed.events(spark).count() == 16


def test_query_stops_when_both_failure_sinks_fail_and_repeats_the_batch(spark, tmp_path):
    topic, checkpoint = str(tmp_path / "topic"), str(tmp_path / "checkpoint")
    write_topic(spark, topic, files=1)
    tables = Tables.under(str(tmp_path / "t")).create(spark)

    def down(_):
        raise OSError("down")

    failing = IngestJob(tables, failure_sink=with_fallback(down, down))
    with pytest.raises(Exception, match="all failure backends unavailable"):
        failing.start(message_stream_files(spark, topic), checkpoint, trigger=NOW).awaitTermination()
    IngestJob(tables).start(message_stream_files(spark, topic), checkpoint, trigger=NOW).awaitTermination()
    assert (tables.events(spark).count(), tables.failed(spark).count()) == (15, 20)


def test_secondary_sink_is_used_only_when_the_primary_fails(spark):
    used = []

    def sink(name, fails=False):
        def write(_):
            used.append(name)
            if fails:
                raise OSError(name)

        return write

    def wrong_plan(frame):
        spark.range(1).select("no such column").collect()

    with pytest.raises(AnalysisException):
        with_fallback(wrong_plan, sink("never"))(None)
    with_fallback(sink("a"), sink("b"))(None)
    with_fallback(sink("c", fails=True), sink("d"))(None)
    assert used == ["a", "c", "d"]


def test_stages_are_replaceable(spark, tmp_path):
    tables = Tables.under(str(tmp_path)).create(spark)
    taken = {}
    job = IngestJob(
        tables,
        decode=lambda m: decode(m.where(F.col("value").contains("device_id"))),
        event_sink=lambda f: taken.update(events=f.count()),
        failure_sink=lambda f: taken.update(dead=sorted(r["key"] for r in dlq_records(f).collect())),
        on_counts=lambda b, f: taken.update(counts={(r["stage"], r["domain"]): r["n"] for r in f.collect()}),
    )
    job.run(records(spark, VALUES[:7]), "b1")
    assert taken["events"] == 3 and taken["dead"] == ["process", "transform", "transform"]
    assert taken["counts"][("process", "energy_meter")] == 1


def test_observed_counters(spark):
    seen = Observation("outcomes")
    observe_outcomes(classify(decode(records(spark, VALUES))), seen).write.format("noop").mode("overwrite").save()
    assert seen.get == {"messages": 35, "transformed": 15, "process_errors": 10, "transform_errors": 10}


def test_replayed_files(spark, tmp_path):
    documents = tmp_path / "docs"
    documents.mkdir()
    for i, text in enumerate([energy(), finance() + "\n", "junk"]):
        (documents / f"{i}.json").write_text(text.replace(", ", ",\n  "))
    tables = Tables.under(str(tmp_path / "t")).create(spark)
    for batch in ("b1", "b1"):
        IngestJob(tables).run(replay_documents(spark, str(documents)), batch)
    assert (tables.events(spark).count(), tables.failed(spark).count()) == (2, 1)


def test_replay_of_touched_files_and_equal_lines_in_two_folders(spark, tmp_path):
    for folder in ("a", "b"):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "same.json").write_text(energy() + "\n" + "   \n\n" + finance() + "\n")
    for read, events, failed in ((replay_lines, 4, 4), (replay_documents, 0, 2)):
        tables = Tables.under(str(tmp_path / read.__name__)).create(spark)
        for batch, day in (("b1", 1_700_000_000), ("b2", 1_710_000_000)):
            for folder in ("a", "b"):
                os.utime(tmp_path / folder / "same.json", (day, day))
            IngestJob(tables).run(read(spark, [str(tmp_path / f) for f in ("a", "b")]), batch)
            assert tables.events(spark).count() == events
            assert tables.events(spark).select("event_id").distinct().count() == events
            in_batch = tables.failed(spark).where(F.col("batch_id") == batch).groupBy("stage").count().collect()
            again = {"store": events} if batch == "b2" and events else {}
            assert {r["stage"]: r["count"] for r in in_batch} == {"process": failed, **again}


def test_replayed_lines_keep_equal_lines(spark, tmp_path, monkeypatch):
    from telemill.sources import files

    monkeypatch.setattr(files, "_COPIES_PER_STEP", 7)
    folder = tmp_path / "lines"
    folder.mkdir()
    (folder / "a.json").write_text("\n".join([climate()] * 30 + [energy()] + [""]))
    (folder / "b.json").write_text(climate())
    first, second = (replay_lines(spark, str(folder)) for _ in range(2))
    assert first.count() == 32 and first.select("offset").distinct().count() == 32
    assert first.select("offset", "value").exceptAll(second.select("offset", "value")).isEmpty()


def test_kafka_options():
    config = KafkaConfig(["h1:9092", "h2:9092"], ["a", "b"], dlq_topic="dead", max_offsets_per_trigger=1000)
    assert config.read_options() == {
        "kafka.bootstrap.servers": "h1:9092,h2:9092", "subscribe": "a,b", "startingOffsets": "earliest",
        "includeHeaders": "true", "maxOffsetsPerTrigger": "1000",
    }
    assert config.write_options() == {"kafka.bootstrap.servers": "h1:9092,h2:9092", "topic": "dead"}


def test_windows_take_late_rows_inside_the_watermark_only(spark, tmp_path):
    from datetime import datetime as at

    from pyspark.sql import functions as F

    from telemill.streaming.windows import last_of_each_window, windowed_outcomes

    events, failed, out = (str(tmp_path / n) for n in ("events", "failed", "out"))
    shape = "topic string, ingested_at timestamp_ntz"
    spark.createDataFrame([], "topic string, created_at timestamp_ntz").write.parquet(failed)

    def arrive(*hours):
        rows = [("t", at(2024, 1, 5, h, m)) for h, m in hours]
        spark.createDataFrame(rows, shape).write.mode("append").parquet(events)

    def run():
        stream = windowed_outcomes(
            spark.readStream.schema(shape).parquet(events),
            spark.readStream.schema("topic string, created_at timestamp_ntz").parquet(failed),
            3600,
            "1 hour",
        )
        query = (
            stream.writeStream.outputMode("update")
            .foreachBatch(lambda b, i: b.withColumn("_batch", F.lit(i).cast("long")).write.mode("append").parquet(out))
            .option("checkpointLocation", str(tmp_path / "offsets"))
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
        rows = last_of_each_window(spark.read.parquet(out), 3600).collect()
        return {r["window_start"].hour: r["sent"] for r in rows}

    arrive((10, 0), (12, 0))
    assert run() == {10: 1, 12: 1}
    arrive((11, 30), (9, 30))  # the watermark stands at 11:00: 11:30 counts, 9:30 is too late
    assert run() == {10: 1, 11: 1, 12: 1}


def test_listener_writes_progress_of_every_micro_batch(spark, tmp_path):
    """Each micro-batch's progress reaches the metrics table while the stream runs; the observed
    message counts add up to the messages, without a second pass."""
    import json

    from telemill.streaming.observe import ProgressMetrics

    topic, metrics = str(tmp_path / "topic"), str(tmp_path / "metrics")
    write_topic(spark, topic)
    listener = ProgressMetrics("listened")
    spark.streams.addListener(listener)
    try:
        job = IngestJob(Tables.under(str(tmp_path / "t")).create(spark))
        running = job.start(
            message_stream_files(spark, topic, 1), str(tmp_path / "c"), "listened", NOW, (listener, metrics)
        )
        running.awaitTermination()
        listener.settle(spark, metrics, running)
    finally:
        spark.streams.removeListener(listener)
    rows = spark.read.schema(ProgressMetrics.SCHEMA).parquet(metrics).collect()
    taken = [json.loads(r.observed).get("intake", {}).get("messages", 0) for r in rows]
    assert len(rows) == len(running.recentProgress) >= 2
    assert sum(taken) == sum(r.input_rows for r in rows) == len(VALUES)


def test_copies_across_micro_batches_are_dropped_before_the_key_check(spark, tmp_path):
    """Every message comes twice, in later files: the copies are dropped within the watermark, never
    refused by the key check, and the metrics count them."""
    import json

    from telemill.streaming.observe import ProgressMetrics

    topic, metrics = str(tmp_path / "topic"), str(tmp_path / "metrics")
    write_topic(spark, topic)
    write_topic(spark, topic)
    tables = Tables.under(str(tmp_path / "t")).create(spark)
    listener = ProgressMetrics("deduped")
    spark.streams.addListener(listener)
    try:
        running = IngestJob(tables).start(
            message_stream_files(spark, topic, 4), str(tmp_path / "c"), "deduped", NOW, (listener, metrics), "1 day"
        )
        running.awaitTermination()
        listener.settle(spark, metrics, running)
    finally:
        spark.streams.removeListener(listener)
    events, failed = contents(spark, tables)
    assert (len(events), len(failed)) == (15, 20)
    assert tables.failed(spark).where("stage = 'store'").isEmpty()
    rows = spark.read.schema(ProgressMetrics.SCHEMA).parquet(metrics).collect()
    assert len(rows) >= 2 and sum(r.dropped_copies for r in rows) == len(VALUES)
    assert sum(json.loads(r.observed).get("intake", {}).get("messages", 0) for r in rows) == len(VALUES)


def test_replayed_documents_are_files_of_one_folder(spark, tmp_path, monkeypatch):
    """One file per user, all in one folder; a position delivered twice stays one document."""
    from datetime import datetime

    from telemill import scratch
    from telemill.plans.catalog import QUERIES

    rows = [
        (n, datetime(2024, 1, 1, 0, n), n % 6, kind, 50.0, '{"k": 3}')
        for n, kind in enumerate(["click", "purchase", "view", "signup"] * 3, 1)
    ]
    rows.append(rows[-1])
    schema = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "events.parquet"))
    monkeypatch.setattr(scratch, "new_folder", lambda _, name: str(tmp_path / name))
    result = QUERIES["src_replay_documents"](spark, str(tmp_path)).collect()
    folder = tmp_path / "documents"
    assert len(result) == len(list(folder.glob("*.txt"))) == 6
    assert not [p for p in folder.iterdir() if p.is_dir()]
    assert sum(r["failed_check"] == "malformed" for r in result) == 1


def test_message_files_hold_every_record_in_few_bytes(spark, tmp_path, monkeypatch):
    """The staged topic keeps each record of each delivery, its files compressed to a fraction of the texts."""
    from datetime import datetime

    from telemill import scratch
    from telemill.plans import adapter, catalog

    kinds = ["click", "purchase", "view", "signup", "error"]
    rows = [
        (n, datetime(2024, 1, 1 + n % 9, n % 24, n % 60), n % 50, kinds[n % 5], n * 0.37, f'{{"k": {n % 90}}}')
        for n in range(1000)
    ]
    rows += [(None, None, None, None, None, None), rows[-1]]
    schema = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "events.parquet"))
    monkeypatch.setattr(scratch, "new_folder", lambda _, name: str(tmp_path / name))
    monkeypatch.setattr(catalog, "_RECORDS_PER_FILE", 400)
    folder = catalog._message_files(spark, str(tmp_path), deliveries=2)
    given = adapter.device_messages(spark, str(tmp_path))
    staged = message_files(spark, folder).select(*given.columns)
    assert sorted(map(str, staged.collect())) == sorted(map(str, given.unionByName(given).collect()))
    sizes = [p.stat().st_size for p in (tmp_path / "messages").glob("part-*")]
    texts = staged.agg(F.sum(F.length("value"))).first()[0]
    assert len(sizes) >= 6 and sum(sizes) < texts / 2


def test_fresh_batch_leaves_stored_keys_unread_and_writes_side_by_side(spark, tmp_path, monkeypatch):
    """A micro-batch without a key that may be stored neither lists nor reads the event table, and the quarantine
    table does not wait for the event table."""
    from threading import Barrier

    from telemill.operators import store

    tables = Tables.under(str(tmp_path)).create(spark)
    IngestJob(tables).run(records(spark, VALUES), "b1")
    read, both = [], Barrier(2, timeout=60)
    stored_keys, append_events, append_failures = store.known_keys, store.append_events, store.append_failures
    monkeypatch.setattr(store, "known_keys", lambda events: read.append(1) or stored_keys(events))
    monkeypatch.setattr(store, "append_events", lambda *a: both.wait() is not None and append_events(*a))
    monkeypatch.setattr(store, "append_failures", lambda *a: both.wait() is not None and append_failures(*a))
    IngestJob(tables).run(records(spark, VALUES, start=1000), "b2")
    assert (tables.events(spark).count(), tables.failed(spark).count(), read) == (30, 40, [])
    IngestJob(tables).run(records(spark, VALUES, start=1000), "b2")
    assert (tables.events(spark).count(), tables.failed(spark).count(), read) == (30, 40, [1])


def test_steps_side_by_side_all_end_and_the_first_error_is_raised():
    done = []

    def fails(text):
        raise OSError(text)

    with pytest.raises(OSError, match="first"):
        side_by_side(lambda: fails("first"), lambda: fails("second"), lambda: done.append(3))
    side_by_side()
    assert done == [3]
