"""Explicit schemas. Times are UTC wall-clock ``TIMESTAMP_NTZ``.

``TIMESTAMP_NTZ`` is stored as 64-bit microseconds with row-group statistics, so range
predicates reach the Parquet reader whatever the session time zone or timestamp options.
"""

from pyspark.sql import types as T

HEADERS = T.ArrayType(
    T.StructType([T.StructField("key", T.StringType()), T.StructField("value", T.StringType())])
)

# Shape of the Kafka source, with text keys and values, for files that stand in for a topic.
MESSAGES = T.StructType(
    [
        T.StructField("topic", T.StringType()),
        T.StructField("partition", T.IntegerType()),
        T.StructField("offset", T.LongType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("key", T.StringType()),
        T.StructField("value", T.StringType()),
        T.StructField("headers", HEADERS),
    ]
)

EVENTS = T.StructType(
    [
        T.StructField("event_id", T.StringType(), False),
        T.StructField("event_type", T.StringType(), False),
        T.StructField("entity_id", T.StringType(), False),
        T.StructField("entity_type", T.StringType(), False),
        T.StructField("occurred_at", T.TimestampNTZType(), False),
        T.StructField("ingested_at", T.TimestampNTZType(), False),
        T.StructField("source", T.StringType(), False),
        T.StructField("schema_version", T.StringType(), False),
        T.StructField("data", T.StringType(), False),
        T.StructField("metadata", T.StringType()),
        # lineage
        T.StructField("topic", T.StringType()),
        T.StructField("partition", T.IntegerType()),
        T.StructField("offset", T.LongType()),
        T.StructField("batch_id", T.StringType()),
        # layout
        T.StructField("ingest_date", T.DateType(), False),
        T.StructField("domain", T.StringType(), False),
    ]
)
EVENT_PARTITIONS = ["ingest_date", "domain"]

# The columns of the event record itself, without lineage and layout.
EVENT_COLUMNS = [
    "event_id", "domain", "event_type", "entity_id", "entity_type", "occurred_at",
    "ingested_at", "source", "schema_version", "data", "metadata",
]

FAILED_MESSAGES = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("message", T.StringType()),
        T.StructField("error", T.StringType(), False),
        T.StructField("created_at", T.TimestampNTZType(), False),
        T.StructField("error_type", T.StringType()),
        T.StructField("reason", T.StringType()),
        # what is needed to replay the record
        T.StructField("raw_value", T.StringType()),
        T.StructField("topic", T.StringType()),
        T.StructField("partition", T.IntegerType()),
        T.StructField("offset", T.LongType()),
        T.StructField("batch_id", T.StringType()),
        # layout
        T.StructField("created_date", T.DateType(), False),
        T.StructField("stage", T.StringType(), False),
    ]
)
FAILED_PARTITIONS = ["created_date", "stage"]
