"""Where messages come from."""

from telemill.sources.files import message_files, message_stream_files, replay_documents, replay_lines
from telemill.sources.kafka import KafkaConfig, kafka_batch, kafka_stream, write_dlq

__all__ = [
    "KafkaConfig", "kafka_batch", "kafka_stream", "message_files", "message_stream_files",
    "replay_documents", "replay_lines", "write_dlq",
]
