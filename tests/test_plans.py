"""The plans keep what makes them scale."""

from datetime import datetime

import pytest
from helpers import energy, finance, records

from telemill.operators import reads, store
from telemill.operators.decode import decode
from telemill.operators.store import Tables
from telemill.operators.transform import classify, to_events
from telemill.plans.catalog import QUERIES
from telemill.streaming import IngestJob


def plan(frame) -> str:
    return frame._jdf.queryExecution().explainString(
        frame.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    tables = Tables.under(str(tmp_path_factory.mktemp("plans"))).create(spark)
    IngestJob(tables).run(records(spark, [energy()] * 10 + [finance()] * 10), "b1")
    return tables.events(spark)


def test_transform_is_one_narrow_stage_that_parses_once(spark):
    frame = to_events(classify(decode(records(spark, [energy()]))))
    text = frame._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in text
    assert text.count("from_json(ArrayType") == 1
    assert "Python" not in text


def test_generated_methods_stay_within_what_the_jvm_compiles(spark):
    frame = classify(decode(records(spark, [energy()])))
    stages = frame._jdf.queryExecution().debug().codegenToSeq()
    sizes = [stages.apply(i)._3().maxMethodCodeSize() for i in range(stages.size())]
    assert max(sizes) < 8000, sizes


def test_cursor_reads_push_the_range_and_prune_days(events):
    text = plan(events.where(reads.before(datetime(2024, 1, 5), "x") & (events.ingest_date <= datetime(2024, 1, 5).date())))
    assert "LessThanOrEqual(ingested_at" in text
    assert "PartitionFilters: [isnotnull(ingest_date" in text


def test_lookup_pushes_the_id_and_reads_chosen_columns(events):
    text = plan(reads.get_event(events, "x").select("event_id", "source"))
    assert "EqualTo(event_id,x)" in text
    assert "ReadSchema: struct<event_id:string,source:string>" in text


def test_domain_reads_prune_partitions_and_take_the_top(events):
    text = plan(reads.events_by_domain(events, "energy_meter", 5))
    assert "TakeOrderedAndProject" in text
    assert "(domain" in text.split("PartitionFilters")[1].split("\n")[0]


def test_first_copies_are_limited_before_the_shuffle(events):
    text = plan(store.first_copies(events))
    assert text.count("WindowGroupLimit") >= 2


def test_registered_transform_has_no_exchange(spark):
    frame = QUERIES["transform"](spark, "/root/testdata/sf0.001")
    assert "Exchange" not in frame._jdf.queryExecution().executedPlan().toString()


def test_rows_without_a_doubtful_key_are_not_compared(events):
    """The rows to append are joined with the few doubtful keys and ranked only among those."""
    known = store.known_keys(events)
    text = plan(store.check_keys(events.drop("batch_id"), known, "b2")[0])
    assert "LeftAnti" in text and "LeftSemi" in text and "CartesianProduct" not in text


def test_no_query_uses_python_rows_or_cartesian_products(spark):
    sf_dir = "/root/testdata/sf0.001"
    for name in ("transform", "latest_20", "backlog_series", "throughput_by_window", "freshness", "scan_events"):
        text = plan(QUERIES[name](spark, sf_dir))
        assert "Python" not in text and "CartesianProduct" not in text, name
