"""Files of messages: records in the shape of a topic, or bare message documents."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from telemill import schemas
from telemill.functions.times import format_rfc3339, parse_rfc3339
from telemill.operators.plan import copies


def message_files(spark: SparkSession, path: str) -> DataFrame:
    """Files with one Kafka-shaped record per line."""
    return spark.read.schema(schemas.MESSAGES).json(path)


def message_stream_files(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """The same files as a stream; ``max_files_per_trigger`` bounds a micro-batch."""
    reader = spark.readStream.schema(schemas.MESSAGES)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.json(path)


# Day of replayed texts that name no time of their own, which no event can come from.
_NO_TIME = "1970-01-01T00:00:00Z"


def _replayed(texts: DataFrame, topic: str, *identity: str) -> DataFrame:
    """Texts as records whose position derives from the ``identity`` columns.

    The 64 bits of an offset are too few to tell 10^10 texts apart, so ``record_key`` carries 128 and
    ids are made of it. The arrival time is the message's own time: a file that is touched or copied
    keeps its days, so the key check looks where the first load put its events.
    """
    sent = format_rfc3339(parse_rfc3339(F.get_json_object("value", "$.timestamp")))
    digest = F.md5(F.to_json(F.struct(*identity)))
    return texts.select(
        F.lit(topic).alias("topic"),
        F.lit(0).alias("partition"),
        F.xxhash64(*identity).alias("offset"),
        F.to_timestamp(F.coalesce(sent, F.lit(_NO_TIME))).alias("timestamp"),
        F.lit(None).cast("string").alias("key"),
        "value",
        F.lit(None).cast(schemas.HEADERS).alias("headers"),
        digest.alias("record_key"),
    )


def replay_documents(spark: SparkSession, path: str, topic: str = "replay") -> DataFrame:
    """Message documents, one per file, as records.

    The raw text is kept, so decoding is as strict as for a topic. The record's position derives
    from its path and text: loading the same file again gives the same events. A document is one
    message, so a file's text is one row.
    """
    documents = spark.read.text(path, wholetext=True).select(
        F.btrim("value", F.lit(" \t\r\n")).alias("value"), F.col("_metadata.file_path").alias("file")
    )
    return _replayed(documents, topic, "file", "value")


# Copies of a line that one row may be expanded to at a time.
_COPIES_PER_STEP = 100_000


def replay_lines(spark: SparkSession, path: str, topic: str = "replay") -> DataFrame:
    """Message documents, one per line, as records; a blank line is a record too and fails decoding.

    A line has no position of its own that is the same however the files are split, but equal lines
    of a file are interchangeable. So lines are counted per file (its whole path) and text, and written
    out again with a copy number: the same file always gives the same records. A text that fills a
    large part of a file is combined before the shuffle and written out by many tasks.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"))
    counted = lines.groupBy("file", "value").agg(F.count("*").alias("n"))
    return _replayed(copies(counted, "n", _COPIES_PER_STEP), topic, "file", "value", "copy")
