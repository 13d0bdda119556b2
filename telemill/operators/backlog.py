"""How many messages were waiting: sent but not yet ingested, over time."""

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def backlog_series(events: DataFrame, keys: Sequence[str] = ("topic",), seconds: int = 60) -> DataFrame:
    """Backlog at the end of every minute with any traffic.

    Arrivals and departures are first summed per minute. The running total is then built from two
    short steps, minutes within a day and days within a key, so no task ever walks a key's whole
    history minute by minute.
    """

    def change(at: str, step: int) -> DataFrame:
        minute = F.window(F.col(at), f"{seconds} seconds")["start"]
        return events.select(*keys, minute.alias("minute"), F.lit(step).cast("bigint").alias("step"))

    changes = change("occurred_at", 1).unionByName(change("ingested_at", -1))
    per_minute = changes.groupBy(*keys, "minute").agg(F.sum("step").alias("change"))
    dated = per_minute.withColumn("day", F.to_date("minute"))
    within_day = Window.partitionBy(*keys, "day").orderBy("minute").rowsBetween(Window.unboundedPreceding, 0)
    in_day = dated.withColumn("so_far", F.sum("change").over(within_day))
    per_day = dated.groupBy(*keys, "day").agg(F.sum("change").alias("day_change"))
    earlier_days = Window.partitionBy(*keys).orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    carried = per_day.select(*keys, "day", F.coalesce(F.sum("day_change").over(earlier_days), F.lit(0)).alias("carried"))
    return in_day.join(carried, [*keys, "day"]).select(
        *keys, "minute", (F.col("carried") + F.col("so_far")).alias("backlog")
    )


def backlog_stats(series: DataFrame, keys: Sequence[str] = ("topic",)) -> DataFrame:
    """Peak, truncated mean and last value of a backlog series."""
    return series.groupBy(*keys).agg(
        F.max("backlog").alias("peak"),
        F.floor(F.sum("backlog") / F.count("*")).alias("average"),
        F.max_by("backlog", "minute").alias("final"),
    )
