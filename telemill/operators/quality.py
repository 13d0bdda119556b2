"""Counts, rates, latencies and alerts over messages and the two tables.

Every aggregate combines on the map side, so a key that holds a large part of the rows costs one
partial row per task.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from telemill import fixed
from telemill.functions.times import parse_rfc3339, truncate_second
from telemill.operators.checks import parse_type

SUCCESS = "success"
ERROR = "error"


def table_stats(events: DataFrame, failed: DataFrame) -> DataFrame:
    """Row counts of both tables, as one row."""
    none = F.lit(0).cast("bigint")
    stored = events.agg(F.count("*").alias("total_events")).withColumn("failed_messages", none)
    refused = failed.agg(F.count("*").alias("failed_messages")).withColumn("total_events", none)
    return stored.unionByName(refused).agg(
        F.sum("total_events").alias("total_events"), F.sum("failed_messages").alias("failed_messages")
    )


def failed_by_stage(failed: DataFrame) -> DataFrame:
    return failed.groupBy("stage").agg(F.count("*").alias("n"))


def failed_sample(failed: DataFrame, rows: int = 5) -> DataFrame:
    """A few failures for a report, newest first."""
    return failed.orderBy(F.desc("created_at"), F.desc("id")).select("stage", "error").limit(rows)


def process_totals(classified: DataFrame) -> DataFrame:
    """Messages by outcome of the process stage."""
    failed = F.coalesce(F.col("stage") == fixed.STAGE_PROCESS, F.lit(False))
    return (
        classified.groupBy(
            F.lit("process_data").alias("operation"), F.when(failed, ERROR).otherwise(SUCCESS).alias("status")
        )
        .agg(F.count("*").alias("total"))
    )


def poll_totals(classified: DataFrame) -> DataFrame:
    """Records by poll status; the device type is known only where the record decodes."""
    malformed = F.coalesce(F.col("failed_check") == "malformed", F.lit(False))
    return classified.groupBy(
        F.lit("poll_message").alias("operation"),
        F.when(malformed, ERROR).otherwise(SUCCESS).alias("status"),
        F.when(~malformed, F.col("type")).alias("device_type"),
    ).agg(F.count("*").alias("total"))


def transform_totals(classified: DataFrame) -> DataFrame:
    """Messages that reached the transform: successes by domain and event type, errors by device type."""
    reached = classified.where(F.coalesce(F.col("stage") != fixed.STAGE_PROCESS, F.lit(True)))
    good = F.col("stage").isNull()
    return reached.groupBy(
        F.when(good, SUCCESS).otherwise(ERROR).alias("status"),
        F.when(good, F.col("domain")).alias("domain"),
        F.when(good, F.col("type")).alias("event_type"),
        F.when(~good, F.col("type")).alias("device_type"),
    ).agg(F.count("*").alias("total"))


def transform_errors(classified: DataFrame) -> DataFrame:
    """Transform errors by device type and device."""
    return (
        classified.where(F.col("stage") == fixed.STAGE_TRANSFORM)
        .groupBy(F.col("type").alias("device_type"), "device_id")
        .agg(F.count("*").alias("errors"))
    )


def store_totals(accepted: DataFrame, conflicts: DataFrame) -> DataFrame:
    """Store attempts by domain, event type, entity type, source and status."""
    labels = ["domain", "event_type", "entity_type", "source"]

    def counted(frame: DataFrame, status: str) -> DataFrame:
        return frame.groupBy(*labels, F.lit(status).alias("status")).agg(F.count("*").alias("total"))

    return counted(accepted, SUCCESS).unionByName(counted(conflicts, ERROR))


def latency_seconds(occurred_at: Column, arrived_at: Column) -> Column:
    """Time from the event's occurrence to its arrival."""
    return F.timestamp_diff("MICROSECOND", occurred_at, arrived_at) / 1_000_000


def latencies(events: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """``status, domain, seconds`` of stored events and of messages refused after the process stage.

    A message the transform refused has no domain. The quarantine table keeps times to the second, so
    both ends of a refused message's latency are taken to the second.
    """
    seconds = latency_seconds(F.col("occurred_at"), F.col("ingested_at"))
    stored = events.select(F.lit(SUCCESS).alias("status"), "domain", seconds.alias("seconds"))
    if failed is None:
        return stored
    occurred_at = truncate_second(parse_rfc3339(F.get_json_object("message", "$.timestamp")))
    domain = F.when(F.col("stage") == fixed.STAGE_STORE, parse_type(F.get_json_object("message", "$.type")))
    refused = failed.where(F.col("stage") != fixed.STAGE_PROCESS).select(
        F.lit(ERROR).alias("status"),
        domain.alias("domain"),
        latency_seconds(occurred_at, F.col("created_at")).alias("seconds"),
    )
    return stored.unionByName(refused)


def latency_histogram(timed: DataFrame, boundaries: Sequence[float] = fixed.LATENCY_BOUNDARIES) -> DataFrame:
    """``latencies`` per status, domain and bucket. A bucket holds values up to and including its bound."""
    bucket = F.coalesce(*[F.when(F.col("seconds") <= b, F.lit(str(b))) for b in boundaries], F.lit("+Inf"))
    return timed.groupBy("status", "domain", bucket.alias("le")).agg(F.count("*").alias("n"))


def latency_percentiles(timed: DataFrame) -> DataFrame:
    """Median, 95th and 99th percentile of ``latencies`` per status and domain, from mergeable sketches."""
    return timed.groupBy("status", "domain").agg(
        *[F.percentile_approx("seconds", q, 10000).alias(f"p{round(q * 100)}") for q in (0.5, 0.95, 0.99)]
    )


def throughput_by_window(
    events: DataFrame, failed: DataFrame, seconds: int = 3600, keys: Sequence[str] = ("topic",)
) -> DataFrame:
    """Messages sent and stored, success rate in percent and stored events per second, by window."""

    def outcomes(frame: DataFrame, at: str, stored: int) -> DataFrame:
        start = F.window(F.col(at), f"{seconds} seconds")["start"]
        return frame.select(*keys, start.alias("window_start"), F.lit(stored).alias("stored"))

    both = outcomes(events, "ingested_at", 1).unionByName(outcomes(failed, "created_at", 0))
    return (
        both.groupBy(*keys, "window_start")
        .agg(F.count("*").alias("sent"), F.sum("stored").alias("processed"))
        .withColumns(
            {
                "success_rate": F.round(F.col("processed") / F.col("sent") * 100, 2),
                "throughput": F.round(F.col("processed") / seconds, 1),
            }
        )
    )


def throughput_tier(throughput: Column) -> Column:
    tiers = [F.when(throughput >= low, F.lit(name)) for low, name in fixed.THROUGHPUT_TIERS]
    return F.coalesce(*tiers, F.lit(fixed.LOWEST_TIER))


def throughput_trend(series: DataFrame, runs: int = 10) -> DataFrame:
    """The latest windows, newest first."""
    return series.orderBy(F.desc("window_start"), "topic").limit(runs)


def regression_vs_previous(series: DataFrame, keys: Sequence[str] = ("topic",)) -> DataFrame:
    """Change of the throughput against the previous window, in percent, and what it means.

    The series has one row per window, so a key's part of it is bounded by the calendar.
    """
    previous = F.lag("processed").over(Window.partitionBy(*keys).orderBy("window_start"))
    change = F.round((F.col("processed") - F.col("previous")) / F.col("previous") * 100, 1)
    limit = fixed.REGRESSION_PERCENT
    verdict = (
        F.when(F.col("previous").isNull() | (F.col("previous") == 0), "first run")
        .when(F.col("change_percent") < -limit, "regression")
        .when(F.col("change_percent") > limit, "improvement")
        .otherwise("stable")
    )
    return (
        series.select(*keys, "window_start", "processed", previous.alias("previous"))
        .withColumn("change_percent", F.when(F.col("previous") != 0, change))
        .withColumn("verdict", verdict)
    )


def history_union(history: DataFrame, new_run: DataFrame) -> DataFrame:
    """History with the newest run added."""
    return new_run.unionByName(history)


def quality_alerts(stats: DataFrame) -> DataFrame:
    """One row per broken threshold. Needs ``load``, ``peak``, ``average``, ``final`` and
    ``success_rate``; which thresholds count depends on the load level."""
    load = F.col("load")
    rules = [
        ("peak_backlog_over_100", (load == "low") & (F.col("peak") > fixed.PEAK_BACKLOG_LOW)),
        ("success_below_100_percent", (load == "low") & (F.col("success_rate") != 100)),
        ("peak_backlog_over_1000", (load == "medium") & (F.col("peak") > fixed.PEAK_BACKLOG_MEDIUM)),
        ("average_backlog_over_500", (load == "medium") & (F.col("average") > fixed.AVERAGE_BACKLOG_MEDIUM)),
        ("peak_backlog_over_10000", (load == "high") & (F.col("peak") > fixed.PEAK_BACKLOG_HIGH)),
        ("final_backlog_over_1000", (load == "high") & (F.col("final") > fixed.FINAL_BACKLOG_HIGH)),
    ]
    alerts = F.array_compact(F.array(*[F.when(broken, F.lit(name)) for name, broken in rules]))
    return stats.withColumn("alert", F.explode(alerts))


def error_lines(texts: DataFrame, column: str, keys: Sequence[str] = ()) -> DataFrame:
    """Lines that mention an error, whatever the case. Texts are not split into rows."""
    lines = F.split(F.col(column), "\n")
    hits = F.size(F.filter(lines, lambda line: line.rlike(fixed.ERROR_LINE_PATTERN)))
    return texts.groupBy(*keys).agg(F.coalesce(F.sum(hits), F.lit(0)).alias("error_lines"))


def freshness(events: DataFrame, as_of: Column | None = None) -> DataFrame:
    """Time since the last event per source and whether it is too long ago.

    Without ``as_of`` the newest arrival of all sources is the clock.
    """
    latest = events.groupBy("source").agg(F.max("ingested_at").alias("last_ingested_at"))
    if as_of is None:
        # One row per source is all that this window spans.
        as_of = F.max("last_ingested_at").over(Window.partitionBy())
    latest = latest.withColumn("as_of", as_of)
    age = F.timestamp_diff("SECOND", F.col("last_ingested_at"), F.col("as_of"))
    return latest.select(
        "source",
        "last_ingested_at",
        age.alias("age_seconds"),
        (age > fixed.STALE_AFTER_SECONDS).alias("is_stale"),
    )


def health_rollup(checks: DataFrame) -> DataFrame:
    """One row: ``status`` and every check's result as a JSON object by name.

    ``checks`` has ``name`` and ``error`` (NULL when fine), one row per probe.
    """
    result = F.struct("name", F.coalesce("error", F.lit("ok")).alias("result"))
    healthy = F.coalesce(F.bool_and(F.col("error").isNull()), F.lit(True))
    return checks.agg(
        F.when(healthy, "healthy").otherwise("unhealthy").alias("status"),
        F.to_json(F.map_from_entries(F.array_sort(F.collect_list(result)))).alias("checks"),
    )
