"""Thresholds and roll-ups."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from telemill.operators import backlog, quality

T0 = datetime(2024, 1, 1)


def test_alert_thresholds(spark):
    rows = [
        ("low", 101, 0, 0, 100.0), ("low", 100, 9999, 9999, 99.99), ("medium", 1001, 501, 5000, 50.0),
        ("medium", 1000, 500, 0, 0.0), ("high", 10001, 9999, 1001, 0.0), ("high", 10000, 0, 1000, 0.0),
    ]
    stats = spark.createDataFrame(rows, "load string, peak bigint, average bigint, final bigint, success_rate double")
    found = sorted((r["load"], r["peak"], r["alert"]) for r in quality.quality_alerts(stats).collect())
    assert found == [
        ("high", 10001, "final_backlog_over_1000"),
        ("high", 10001, "peak_backlog_over_10000"),
        ("low", 100, "success_below_100_percent"),
        ("low", 101, "peak_backlog_over_100"),
        ("medium", 1001, "average_backlog_over_500"),
        ("medium", 1001, "peak_backlog_over_1000"),
    ]


def test_tiers(spark):
    frame = spark.createDataFrame([(v,) for v in (24.9, 25.0, 50.0, 99.9, 100.0)], "v double").coalesce(1)
    tiers = [r[0] for r in frame.select(quality.throughput_tier(F.col("v"))).collect()]
    assert tiers == ["Poor", "Moderate", "Good", "Good", "Excellent"]


def test_regression_verdicts(spark):
    rows = [("t", T0 + timedelta(hours=i), n) for i, n in enumerate([100, 89, 98, 88, 0, 5])]
    series = spark.createDataFrame(rows, "topic string, window_start timestamp_ntz, processed bigint")
    found = quality.regression_vs_previous(series).orderBy("window_start").collect()
    assert [r["verdict"] for r in found] == ["first run", "regression", "improvement", "regression", "regression", "first run"]
    assert found[1]["change_percent"] == -11.0


def test_backlog_against_a_plain_walk(spark):
    rows = [("t", T0 + timedelta(minutes=37 * i), T0 + timedelta(minutes=37 * i + 100 * (i % 40))) for i in range(200)]
    events = spark.createDataFrame(rows, "topic string, occurred_at timestamp_ntz, ingested_at timestamp_ntz")
    changes = {}
    for _, start, end in rows:
        changes[start] = changes.get(start, 0) + 1
        changes[end] = changes.get(end, 0) - 1
    expected, level = {}, 0
    for minute in sorted(changes):
        level += changes[minute]
        expected[minute] = level
    series = backlog.backlog_series(events)
    assert {r["minute"]: r["backlog"] for r in series.collect()} == expected
    stats = backlog.backlog_stats(series).first()
    assert stats["peak"] == max(expected.values())
    assert stats["average"] == sum(expected.values()) // len(expected)
    assert stats["final"] == 0


def test_freshness_and_health(spark):
    rows = [("a", T0), ("a", T0 + timedelta(seconds=500)), ("b", T0 + timedelta(seconds=379)), ("c", T0 + timedelta(seconds=380))]
    events = spark.createDataFrame(rows, "source string, ingested_at timestamp_ntz")
    stale = {r["source"]: r["is_stale"] for r in quality.freshness(events).collect()}
    assert stale == {"a": False, "b": True, "c": False}
    clock = F.lit(T0 + timedelta(hours=1)).cast("timestamp_ntz")
    assert all(r["is_stale"] for r in quality.freshness(events, clock).collect())
    probes = spark.createDataFrame([("db", None), ("kafka", "unreachable")], "name string, error string")
    assert tuple(quality.health_rollup(probes).first()) == ("unhealthy", '{"db":"ok","kafka":"unreachable"}')
    assert tuple(quality.health_rollup(probes.where("name = 'db'")).first()) == ("healthy", '{"db":"ok"}')


def test_error_lines(spark):
    texts = spark.createDataFrame([("an ERROR\nfine\nit Failed and failed\n",), ("panic",), ("",), (None,)], "text string")
    assert quality.error_lines(texts, "text").first()["error_lines"] == 3
