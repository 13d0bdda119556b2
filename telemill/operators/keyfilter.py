"""A Bloom filter of stored keys per arrival day, kept as a table beside the event table.

The filter of a day is ``SHARDS * WORDS`` 64-bit words. A key goes to one word by its hash and sets up to
``HASHES`` bits of that word, its mask: one row per key is all that is made and shuffled. The table holds
one row per (day, shard, word, append) with the bits that append set. Appends write their rows before their
events: a crash between the two leaves bits for keys that are not stored, which only costs a look at the
stored keys, never a missed copy.

``maybe_stored`` asks the filter for a set of keys: a key whose mask is in no row of its word is certainly
not stored, since the append that stored it set all its bits in one row. Only the keys left meet the
stored keys of their days. Keys of days without a filter are not probed at all.

Sizing: 2**20 words a day, 8 MB. With one key a word (a million a day) the false positive rate is
about 1e-4, with four about 3e-3. A false positive is a key that is compared with the stored keys; results
never depend on it. A table without the filter folder (written before it existed, or with the filter of
six words a key, ``-key-filter``) has no filter: all keys are compared.
"""

from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SHARDS = 64
WORDS = 16384
HASHES = 6

#: The day under which keys without a day are filtered; another key of that day only adds a false positive.
NO_DAY = "0001-01-01"

SCHEMA = T.StructType(
    [
        T.StructField("day", T.DateType()),
        T.StructField("shard", T.IntegerType(), False),
        T.StructField("word", T.IntegerType(), False),
        T.StructField("bits", T.LongType(), False),
    ]
)


def _place(key: Column) -> list[Column]:
    """The key's shard, its word within the shard and its mask of bits in that word."""
    first, second = F.xxhash64(key), F.xxhash64(key, F.lit("second probe"))
    bits = [
        F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(F.shiftright(second, 6 * i), F.lit(64)).cast("int"))
        for i in range(HASHES)
    ]
    return [
        F.pmod(first, F.lit(SHARDS)).cast("int").alias("shard"),
        F.pmod(F.shiftright(first, 8), F.lit(WORDS)).cast("int").alias("word"),
        reduce(Column.bitwiseOR, bits).alias("mask"),
    ]


def _day(day: Column) -> Column:
    return F.coalesce(day, F.lit(NO_DAY).cast("date")).alias("day")


def filter_rows(keys: DataFrame, day: str) -> DataFrame:
    """The filter rows of a set of keys (``event_id`` and the day column ``day``): one row per word set."""
    placed = keys.select(_day(F.col(day)), *_place(F.col("event_id")))
    return placed.groupBy("day", "shard", "word").agg(F.bit_or("mask").alias("bits"))


def append(keys: DataFrame, day: str, path: str) -> None:
    """Add the keys of an append to the filter; call it before the events are written.

    Rows are gathered by day, so an append leaves few files a day. Rows of a failed append do no harm,
    so tasks may commit by themselves.
    """
    (
        filter_rows(keys, day)
        .hint("rebalance", "day")
        .write.mode("append")
        .option("mapreduce.fileoutputcommitter.algorithm.version", "2")
        .partitionBy("day")
        .parquet(path)
    )


def create(spark: SparkSession, path: str) -> None:
    spark.createDataFrame([], SCHEMA).write.mode("ignore").partitionBy("day").parquet(path)


def maybe_stored(keys: DataFrame, filters: DataFrame, days: list | None = None) -> DataFrame:
    """Distinct ``event_id``, ``day`` of ``keys`` whose mask is set in a filter row of the day.

    The days that have a filter (the calendar bounds them) are gathered first, unless they are given: keys
    of other days are neither grouped nor sent to the filter.
    """
    if days is None:
        days = [row["day"] for row in filters.select("day").distinct().collect()]
    here = keys.select("event_id", _day(F.col("day"))).where(F.col("day").isin(days)).distinct()
    probes = here.select("event_id", "day", *_place(F.col("event_id")))
    in_word = reduce(Column.__and__, [probes[c] == filters[c] for c in ("day", "shard", "word")])
    is_set = filters["bits"].bitwiseAND(probes["mask"]) == probes["mask"]
    return probes.join(filters, in_word & is_set, "left_semi").select("event_id", "day")


def filtered_days(spark: SparkSession, path: str, days: list) -> list[date] | None:
    """Those of some days that have a filter, or None where the table has no filter."""
    from telemill.operators.store import _stored_days

    try:
        stored = set(_stored_days(spark, path))
    except Exception as error:  # a table created before the filter existed
        if "FileNotFound" in type(error).__name__ or "FileNotFound" in str(error):
            return None
        raise
    return sorted({date.fromisoformat(NO_DAY) if d is None else d for d in days} & stored)


def read(spark: SparkSession, path: str, days: list) -> DataFrame | None:
    """The filter rows of some days, or None where the table has no filter."""
    wanted = filtered_days(spark, path, days)
    if wanted is None:
        return None
    if not wanted:
        return spark.createDataFrame([], SCHEMA).where(F.lit(False))
    return spark.read.schema(SCHEMA).option("basePath", path).parquet(*[f"{path}/day={d}" for d in wanted])
