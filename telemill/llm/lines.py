"""Line dedup by probing a sharded minimal perfect hash.

The keys of long lines are hashed to 128 bits and counted over the corpus (rows per key, largest id).
Keys that reach ``min_rows`` are indexed: they are divided by hash into shards of about ``SHARD_KEYS``
keys, and for each shard a task builds a minimal perfect hash, which gives each key a slot in three
arrays: fingerprint, count, largest id. Documents probe these arrays; lines are never joined with
lines. A line's hash travels to its shard as a few numbers; the shard's arrays come first in the
partition and are held while its lines pass, so memory is bounded by one shard. Each shard is copied
``COPIES`` times and lines choose a copy by document, so that a line of a third of all documents
is probed in many tasks. Only the positions of dropped lines go back to the documents.

The perfect hash keeps, level by level, the bits that one key alone hits; keys that collide go on to
the next level. The fingerprint has 64 bits that are independent of the slot's, so a line that is not
indexed passes for one that is with a chance of 2**-64.

Nulls and ties: null text counts as one empty line. Each row counts as a document of its own, also if
it repeats; rows that share the largest id all keep their line. A null id is smaller than every id; a
key of null ids only is kept. An empty table gives an empty result. Other columns stay in ``dropped``.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telemill.llm.staging import staged
from telemill.llm.text import BLANKS, lower_ascii, mix

SHARD_KEYS = 1 << 16
COPIES = 8
MAX_LEVELS = 64
_INDEX = "shard bigint, n bigint, bits binary, sizes binary, prints binary, counts binary, keepers binary"
_NO_ID = np.iinfo(np.int64).min


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return F.btrim(line, F.lit(BLANKS))


def long_lines(documents: DataFrame, min_chars: int) -> DataFrame:
    """``doc_id, text_hash, position, h1, h2`` of every line whose key has ``min_chars`` or more."""
    lines = F.transform(split_lines(lower_ascii(F.col("text"))), line_key)
    return (
        documents.select(
            F.col("doc_id").cast("bigint").alias("doc_id"),
            F.xxhash64("text").alias("text_hash"),
            F.posexplode(lines).alias("position", "key"),
        )
        .where(F.length("key") >= min_chars)
        .select(
            "doc_id",
            "text_hash",
            "position",
            F.xxhash64("key").alias("h1"),
            F.xxhash64(F.lit(7), "key").alias("h2"),
        )
    )


def frequent_keys(documents: DataFrame, min_chars: int, min_rows: int) -> DataFrame:
    """``h1, h2, n_rows, keeper`` of keys in at least ``min_rows`` rows; a row counts once."""
    lines = F.transform(split_lines(lower_ascii(F.col("text"))), line_key)
    keys = F.array_distinct(F.filter(lines, lambda k: F.length(k) >= min_chars))
    return (
        documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.explode(keys).alias("key"))
        .select("doc_id", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), "key").alias("h2"))
        .groupBy("h1", "h2")
        .agg(F.count(F.lit(1)).alias("n_rows"), F.max("doc_id").alias("keeper"))
        .where(F.col("n_rows") >= min_rows)
    )


def _level_slots(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    return (mix(keys + np.uint64(level * 0x9E3779B97F4A7C15 % (1 << 64))) % np.uint64(size)).astype(np.int64)


class PerfectHash:
    """Minimal perfect hash of 64-bit keys: one bit array per level, a key's slot is the rank of its bit."""

    def __init__(self, bits: list[np.ndarray]):
        self.bits = bits
        self.before = []
        total = 0
        for level in bits:
            self.before.append(total + np.cumsum(level) - level)
            total += int(level.sum())

    @classmethod
    def build(cls, keys: np.ndarray, spread: float = 2.0) -> "PerfectHash":
        """``keys`` must be distinct."""
        bits, rest = [], keys
        while len(rest):
            if len(bits) == MAX_LEVELS:
                raise ValueError("keys of a perfect hash must be distinct")
            size = max(8, int(len(rest) * spread))
            slots = _level_slots(rest, len(bits), size)
            alone = np.bincount(slots, minlength=size) == 1
            bits.append(alone)
            rest = rest[~alone[slots]]
        return cls(bits)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; -1, or a slot of another key, for a key that is not in the set."""
        found = np.full(len(keys), -1, np.int64)
        open_ = np.arange(len(keys))
        for level, alone in enumerate(self.bits):
            if not len(open_):
                break
            at = _level_slots(keys[open_], level, len(alone))
            hit = alone[at]
            found[open_[hit]] = self.before[level][at[hit]]
            open_ = open_[~hit]
        return found

    def stored(self) -> tuple[bytes, bytes]:
        sizes = np.array([len(b) for b in self.bits], np.int64)
        return b"".join(np.packbits(b).tobytes() for b in self.bits), sizes.tobytes()

    @classmethod
    def loaded(cls, bits: bytes, sizes: bytes) -> "PerfectHash":
        levels, at = [], 0
        for size in np.frombuffer(sizes, np.int64):
            length = -(-int(size) // 8)
            packed = np.frombuffer(bits, np.uint8, length, at)
            levels.append(np.unpackbits(packed, count=int(size)).astype(bool))
            at += length
        return cls(levels)


def _build_shard(group: pd.DataFrame) -> pd.DataFrame:
    keys = group["h1"].to_numpy(np.int64).view(np.uint64)
    prints = group["h2"].to_numpy(np.int64)
    # Two keys that share the first 64 bits are told apart by the second.
    table = PerfectHash.build(keys ^ mix(prints.view(np.uint64)) if len(np.unique(keys)) < len(keys) else keys)
    mixed = len(np.unique(keys)) < len(keys)
    slots = table.slots(keys ^ mix(prints.view(np.uint64)) if mixed else keys)
    order = np.argsort(slots)
    bits, sizes = table.stored()
    keepers = group["keeper"].fillna(_NO_ID).to_numpy(np.int64)
    return pd.DataFrame({
        "shard": [int(group["shard"].iloc[0])],
        "n": [-len(keys) if mixed else len(keys)],
        "bits": [bits],
        "sizes": [sizes],
        "prints": [prints[order].tobytes()],
        "counts": [group["n_rows"].to_numpy(np.int64)[order].tobytes()],
        "keepers": [keepers[order].tobytes()],
    })


class Shard:
    """The arrays of one shard, ready to be probed."""

    def __init__(self, row: dict):
        self.mixed = row["n"] < 0
        self.table = PerfectHash.loaded(row["bits"], row["sizes"])
        self.prints = np.frombuffer(row["prints"], np.int64)
        self.counts = np.frombuffer(row["counts"], np.int64)
        self.keepers = np.frombuffer(row["keepers"], np.int64)

    def doomed(self, h1: np.ndarray, h2: np.ndarray, ids: np.ndarray, min_rows: int) -> np.ndarray:
        """Which of the lines are indexed, frequent, and not of the document that keeps them."""
        keys = h1.view(np.uint64)
        slots = self.table.slots(keys ^ mix(h2.view(np.uint64)) if self.mixed else keys)
        safe = np.maximum(slots, 0)
        known = (slots >= 0) & (self.prints[safe] == h2)
        return known & (self.counts[safe] >= min_rows) & (self.keepers[safe] != ids)


def build_index(keys: DataFrame) -> tuple[DataFrame, int]:
    """The shards of the index, stored, and their number (it follows the number of keys)."""
    keys = staged(keys, "line-keys")
    shards = max(1, -(-keys.count() // SHARD_KEYS))
    shard = F.pmod("h1", F.lit(shards)).alias("shard")
    return staged(keys.select(shard, "*").groupBy("shard").applyInPandas(_build_shard, _INDEX), "line-index"), shards


def _probe(batches: Iterator[pa.RecordBatch], min_rows: int) -> Iterator[pa.RecordBatch]:
    held, current = None, None
    names = ["doc_id", "text_hash", "position"]
    for batch in batches:
        where = batch.column("place").to_numpy()
        kinds = batch.column("is_line").to_numpy(zero_copy_only=False)
        ids = batch.column("doc_id").fill_null(_NO_ID).to_numpy()
        h1, h2 = (batch.column(c).fill_null(0).to_numpy() for c in ("h1", "h2"))
        hit = np.zeros(len(where), bool)
        for run in np.split(np.arange(len(where)), np.flatnonzero(np.diff(where) | np.diff(kinds.astype(np.int8))) + 1):
            if not len(run):
                continue
            if not kinds[run[0]]:
                row = batch.slice(int(run[0]), 1).select(["n", "bits", "sizes", "prints", "counts", "keepers"])
                held, current = Shard(row.to_pylist()[0]), where[run[0]]
            elif held is not None and current == where[run[0]]:
                hit[run] = held.doomed(h1[run], h2[run], ids[run], min_rows)
        yield batch.select(names).filter(pa.array(hit))


def doomed_lines(documents: DataFrame, min_chars: int, min_rows: int) -> DataFrame:
    """``doc_id, text_hash, position`` of every line that goes."""
    index, shards = build_index(frequent_keys(documents, min_chars, min_rows))
    lines = long_lines(documents, min_chars)
    place = F.pmod("h1", F.lit(shards)) * COPIES + F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(COPIES))
    probes = lines.select(
        place.alias("place"), F.lit(True).alias("is_line"), "*",
        *[F.lit(None).cast(t).alias(c) for c, t in (f.split() for f in _INDEX.split(", ")[1:])],
    )
    arrays = index.select(
        F.explode(F.sequence(F.lit(0), F.lit(COPIES - 1))).alias("copy"), "*"
    ).select(
        (F.col("shard") * COPIES + F.col("copy")).alias("place"),
        F.lit(False).alias("is_line"),
        *[F.lit(None).cast(t).alias(c) for c, t in lines.dtypes],
        *[c.split()[0] for c in _INDEX.split(", ")[1:]],
    )
    return (
        probes.unionByName(arrays)
        .repartition("place")
        .sortWithinPartitions("place", "is_line")
        .mapInArrow(lambda batches: _probe(batches, min_rows), "doc_id bigint, text_hash bigint, position int")
    )


def dropped(documents: DataFrame, min_chars: int = 40, min_rows: int = 5) -> DataFrame:
    """``documents`` with ``text`` less the lines that go, and ``n_lines``, ``n_dropped`` added."""
    gone = (
        doomed_lines(documents, min_chars, min_rows)
        .groupBy("doc_id", "text_hash")
        .agg(F.collect_set("position").alias("gone"))
    )
    columns = documents.columns
    whole = documents.select(
        F.struct("*").alias("document"), F.xxhash64("text").alias("hash"), split_lines(F.col("text")).alias("lines")
    )
    joined = whole.join(
        gone,
        F.col("document.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("hash") == F.col("text_hash")),
        "left",
    )
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    text = F.when(F.col("gone").isNull(), F.col("document.text")).otherwise(
        F.array_join(F.transform(left, lambda k: F.get(F.col("lines"), k)), "\n")
    )
    return joined.select(
        *[text.alias("text") if c == "text" else F.col("document").getField(c).alias(c) for c in columns],
        F.size("lines").cast("bigint").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("bigint").alias("n_dropped"),
    )


def dedup_lines(documents: DataFrame, min_chars: int = 40, min_rows: int = 5) -> DataFrame:
    """``doc_id, n_lines, n_dropped, kept_sha256``."""
    kept = dropped(documents.select("doc_id", "text"), min_chars, min_rows)
    return kept.select(
        "doc_id",
        "n_lines",
        "n_dropped",
        F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"),
    )
