"""Topics. Needs Spark's Kafka connector on the class path."""

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class KafkaConfig:
    """One query reads all topics; the topic stays a column, its partitions become tasks."""

    brokers: Sequence[str]
    topics: Sequence[str]
    dlq_topic: str | None = None
    group_id: str | None = None
    starting_offsets: str = "earliest"
    min_offsets_per_trigger: int | None = None
    max_offsets_per_trigger: int | None = None
    max_trigger_delay: str | None = None

    def read_options(self) -> dict[str, str]:
        options = {
            "kafka.bootstrap.servers": ",".join(self.brokers),
            "subscribe": ",".join(self.topics),
            "startingOffsets": self.starting_offsets,
            "includeHeaders": "true",
        }
        optional = {
            "kafka.group.id": self.group_id,
            "minOffsetsPerTrigger": self.min_offsets_per_trigger,
            "maxOffsetsPerTrigger": self.max_offsets_per_trigger,
            "maxTriggerDelay": self.max_trigger_delay,
        }
        return options | {k: str(v) for k, v in optional.items() if v is not None}

    def write_options(self) -> dict[str, str]:
        return {"kafka.bootstrap.servers": ",".join(self.brokers), "topic": self.dlq_topic or ""}


def kafka_stream(spark: SparkSession, config: KafkaConfig) -> DataFrame:
    return spark.readStream.format("kafka").options(**config.read_options()).load()


def kafka_batch(spark: SparkSession, config: KafkaConfig) -> DataFrame:
    """The topics' current content, for a backfill."""
    streaming_only = {"minOffsetsPerTrigger", "maxOffsetsPerTrigger", "maxTriggerDelay"}
    options = {k: v for k, v in config.read_options().items() if k not in streaming_only}
    return spark.read.format("kafka").options(**options).load()


def write_dlq(records: DataFrame, config: KafkaConfig) -> None:
    """Send dead-letter records (``key``, ``value``) to the configured topic."""
    records.write.format("kafka").options(**config.write_options()).save()
