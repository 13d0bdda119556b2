"""Throughput by window while the stream runs: a watermark bounds the state, ``window()`` makes the groups.

Sent and stored messages are counted per key and window by Spark's stateful streaming aggregation. The
watermark trails the newest time seen by ``late``: a row older than the watermark when it arrives is left
out, and the state of a window is dropped once the watermark passes its end. In update mode every
micro-batch writes the windows it changed, with its batch id, to a table in a shared folder; the result
is the last row of each window. With rows that arrive inside the watermark it equals the batch
``quality.throughput_by_window``.
"""

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from telemill import schemas


def windowed_outcomes(
    events: DataFrame, failed: DataFrame, seconds: int, late: str, keys: Sequence[str] = ("topic",)
) -> DataFrame:
    """Sent and processed messages per key and window of two streams (stored events, refused messages)."""

    def outcomes(frame: DataFrame, at: str, stored: int) -> DataFrame:
        return frame.select(*keys, F.col(at).cast("timestamp").alias("moment"), F.lit(stored).alias("stored"))

    both = outcomes(events, "ingested_at", 1).unionByName(outcomes(failed, "created_at", 0))
    grouped = both.withWatermark("moment", late).groupBy(*keys, F.window("moment", f"{seconds} seconds"))
    return grouped.agg(F.count("*").alias("sent"), F.sum("stored").alias("processed")).select(
        *keys,
        F.col("window.start").cast("timestamp_ntz").alias("window_start"),
        "sent",
        F.col("processed").cast("long").alias("processed"),
    )


def last_of_each_window(updates: DataFrame, seconds: int, keys: Sequence[str] = ("topic",)) -> DataFrame:
    """The latest update of every window, with rate and throughput as the batch query gives them."""
    latest = Window.partitionBy(*keys, "window_start").orderBy(F.desc("_batch"))
    last = updates.withColumn("_k", F.row_number().over(latest)).where("_k = 1")
    return last.select(
        *keys,
        "window_start",
        "sent",
        "processed",
        F.round(F.col("processed") / F.col("sent") * 100, 2).alias("success_rate"),
        F.round(F.col("processed") / seconds, 1).alias("throughput"),
    )


def stream_throughput(
    spark: SparkSession,
    events_path: str,
    failed_path: str,
    folder: str,
    checkpoint: str,
    seconds: int = 3600,
    late: str = "2 days",
    files_per_trigger: int = 64,
) -> DataFrame:
    """Run the windowed count over the files of both tables (all that are there now) and read its result.

    Several micro-batches as the tables grow (``files_per_trigger``); running it again with the same
    ``checkpoint`` takes only files that came since, and late rows update their window while it is open.
    """
    events = (
        spark.readStream.schema(schemas.EVENTS).option("maxFilesPerTrigger", files_per_trigger).parquet(events_path)
    )
    failed = (
        spark.readStream.schema(schemas.FAILED_MESSAGES)
        .option("maxFilesPerTrigger", files_per_trigger)
        .parquet(failed_path)
    )

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("_batch", F.lit(batch_id).cast("long")).write.mode("append").parquet(folder)

    query = (
        windowed_outcomes(events, failed, seconds, late)
        .writeStream.outputMode("update")
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return last_of_each_window(spark.read.parquet(folder), seconds)
