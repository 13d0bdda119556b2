"""Session settings the library is tuned for."""

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Equal keys in one JSON object: the last one counts.
    "spark.sql.variant.allowDuplicateKeys": "true",
    # Streaming state on disk, checkpointed by its changes (deduplication within the watermark, windows).
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def build(app_name: str = "telemill", **settings: str) -> SparkSession:
    """A session with these settings; size-dependent ones (shuffle partitions, memory) are the
    cluster's business or the caller's."""
    builder = SparkSession.builder.appName(app_name)
    for key, value in {**SETTINGS, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
