"""Counters that are gathered while the data flows by, without a second pass."""

import json
import threading
import time

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from telemill import fixed


def observe_outcomes(classified: DataFrame, observation: Observation | str) -> DataFrame:
    """Attach message counts by outcome. Observe a frame that is evaluated once: every evaluation
    counts again."""

    def count(condition: Column) -> Column:
        return F.count(F.when(condition, 1))

    return classified.observe(
        observation,
        F.count(F.lit(1)).alias("messages"),
        count(F.col("stage").isNull()).alias("transformed"),
        count(F.col("stage") == fixed.STAGE_PROCESS).alias("process_errors"),
        count(F.col("stage") == fixed.STAGE_TRANSFORM).alias("transform_errors"),
    )


class ProgressMetrics(StreamingQueryListener):
    """Progress of a running stream, one row per micro-batch, gathered by Spark's listener bus.

    After each micro-batch Spark reports its progress on the driver: the batch, input rows, rates and the
    stream's own observed metrics (``observe`` on the streaming frame). The rows wait in memory until
    ``flush`` appends them to a table; ``IngestJob`` flushes at the start of every micro-batch and once the
    stream has ended, so the metrics leave the stream by themselves, without a pass over the data.
    """

    SCHEMA = (
        "query_id string, batch bigint, at string, input_rows bigint, input_per_s double, "
        "processed_per_s double, observed string, dropped_copies bigint"
    )

    def __init__(self, name: str | None = None):
        self.name = name
        self.pending: list[tuple] = []
        self.seen = 0
        self._lock = threading.Lock()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        if self.name is not None and progress.name != self.name:
            return
        observed = {name: row.asDict() for name, row in (progress.observedMetrics or {}).items()}
        row = (
            str(progress.id),
            int(progress.batchId),
            progress.timestamp,
            int(progress.numInputRows),
            float(progress.inputRowsPerSecond or 0.0),
            float(progress.processedRowsPerSecond or 0.0),
            json.dumps(observed, default=str, sort_keys=True),
            sum(int((op.customMetrics or {}).get("numDroppedDuplicateRows", 0)) for op in progress.stateOperators or []),
        )
        with self._lock:
            self.pending.append(row)
            self.seen += 1

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def flush(self, spark: SparkSession, path: str) -> None:
        """Append the rows gathered so far to the metrics table at ``path``."""
        with self._lock:
            rows, self.pending = self.pending, []
        if rows:
            spark.createDataFrame(rows, self.SCHEMA).write.mode("append").parquet(path)

    def settle(self, spark: SparkSession, path: str, query, wait_s: float = 30.0) -> None:
        """After the stream has ended: wait for the progress events still on the bus, then flush."""
        ends = time.monotonic() + wait_s
        while self.seen < len(query.recentProgress) and time.monotonic() < ends:
            time.sleep(0.05)
        self.flush(spark, path)
