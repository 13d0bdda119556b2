"""Near-dedup by min-max hashing of word shingles.

Each of ``PERMUTATIONS`` hash functions runs once over a document's shingles and gives two signature
values, the smallest and the largest hash; both agree between two sets with a chance equal to their
similarity. Bands of ``BAND_VALUES`` values (minima and maxima) bring documents together; a pair of
similarity 0.8 misses all bands with a chance of ``(1 - 0.8**6)**32``, below 1e-4. Every link is confirmed
on the full sets.

Documents of equal sets form one class, linked as such; only one document of a class is compared. In
a bucket not all pairs are made. First every member is compared with the bucket's hub, and links join
the members to components. What is left are pairs in different components: tasks go through a bucket
block by block and compare sketches, eight bits of each of ``2 * SKETCH`` further minima and maxima. The
``BEST`` most similar partners of members outside the bucket's largest component are confirmed
first, and at last all pairs whose estimate is within ``MARGIN`` (three standard deviations) of the
threshold. A pair that shares several buckets is taken from the first. A hub meets
its members in slices, so no task gets all of a large bucket.

Nulls and ties: null text and text without words have an empty set, linked with nothing and kept. With
fewer words than a shingle has, the whole sequence is the one shingle. Repeated rows are in one
class; those that carry the smallest id are all kept. A null id is no candidate for the smallest id; a
component of null ids only has a null id and keeps all rows. Columns other than id and text are ignored.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telemill.llm.components import connected
from telemill.llm.groups import grouped
from telemill.llm.staging import staged
from telemill.llm.text import flat, mix, row_slices, word_hashes

PERMUTATIONS = 96
BAND_VALUES = 6
BANDS = 2 * PERMUTATIONS // BAND_VALUES
SLICE = 1 << 20
BLOCK = 1024
BEST = 2
SKETCH = 256
MARGIN = 0.055
HUB_SLICES = 16

_random = np.random.default_rng(20_240_607)
_FACTORS = _random.integers(0, 1 << 63, PERMUTATIONS + SKETCH, np.uint64) << np.uint64(1) | np.uint64(1)
_TERMS = _random.integers(0, 1 << 63, PERMUTATIONS + SKETCH, np.uint64)
_STEP = np.uint64(0xD6E8FEB86659FD93)


def shingles(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, ascending, and the ``len + 1`` borders of the texts."""
    hashes, rows = word_hashes(data, offsets)
    n = len(offsets) - 1
    counts = np.bincount(rows, minlength=n)
    ends = np.cumsum(counts)
    place = np.arange(len(hashes)) - np.repeat(ends - counts, counts)
    # A shingle starts where enough words follow, or at the first word of a shorter text.
    room = np.repeat(counts, counts) - place
    starts = np.flatnonzero((room >= words) | ((place == 0) & (room < words)))
    width = np.minimum(room[starts], words)
    value = np.zeros(len(starts), np.uint64)
    padded = np.r_[hashes, np.zeros(words, np.uint64)]
    for k in range(words):
        value = np.where(k < width, value * _STEP + padded[starts + k], value)
    value = mix(value + width.astype(np.uint64))
    owner = rows[starts]
    borders = np.searchsorted(owner, np.arange(n + 1))
    sets = [np.unique(value[borders[k] : borders[k + 1]]) for k in range(n)]
    sizes = np.array([len(s) for s in sets], np.int64)
    return (np.concatenate(sets) if sets else value), np.r_[0, np.cumsum(sizes)]


def min_max(values: np.ndarray, borders: np.ndarray, functions: range) -> np.ndarray:
    """Smallest and largest value of each hash function over each set; no set may be empty."""
    found = np.empty((len(borders) - 1, 2 * len(functions)), np.uint64)
    for k, function in enumerate(functions):
        hashed = values * _FACTORS[function] + _TERMS[function]
        found[:, 2 * k] = np.minimum.reduceat(hashed, borders[:-1])
        found[:, 2 * k + 1] = np.maximum.reduceat(hashed, borders[:-1])
    return found


def band_hashes(values: np.ndarray, borders: np.ndarray) -> np.ndarray:
    """The ``BANDS`` band hashes of each set."""
    signature = min_max(values, borders, range(PERMUTATIONS))
    bands = np.zeros((len(borders) - 1, BANDS), np.uint64)
    for k in range(BAND_VALUES):
        bands = mix(bands * _STEP + signature[:, k::BAND_VALUES])
    return bands.view(np.int64)


def sketches(values: np.ndarray, borders: np.ndarray) -> np.ndarray:
    """A byte of each of the further minima and maxima."""
    return mix(min_max(values, borders, range(PERMUTATIONS, PERMUTATIONS + SKETCH))).astype(np.uint8)


def _sign(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = flat(batch.column("text"))
        for start, end in row_slices(offsets, SLICE):
            part = data[offsets[start] : offsets[end]]
            values, borders = shingles(part, offsets[start : end + 1] - offsets[start], words)
            sizes = np.diff(borders)
            full = np.flatnonzero(sizes)
            low, high = (np.zeros(end - start, np.uint64) for _ in range(2))
            bands = np.zeros((0, BANDS), np.int64)
            if len(full):
                starts = borders[full]
                low[full] = np.add.reduceat(mix(values ^ np.uint64(1)), starts)
                high[full] = np.add.reduceat(mix(values * _STEP), starts)
                bands = band_hashes(values, np.r_[starts, borders[-1]])
            counts = np.where(sizes > 0, BANDS, 0)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").slice(start, end - start),
                    batch.column("raw").slice(start, end - start),
                    pa.array(sizes),
                    pa.array(low.view(np.int64)),
                    pa.array(high.view(np.int64)),
                    pa.ListArray.from_arrays(
                        pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)), pa.array(bands.ravel())
                    ),
                ],
                names=["doc_id", "raw", "n_shingles", "low", "high", "bands"],
            )


def _located(documents: DataFrame) -> DataFrame:
    return documents.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("raw"), "text"
    )


def signatures(documents: DataFrame, words: int) -> DataFrame:
    """Stored: ``row, doc_id, raw, n_shingles, low, high, bands``; ``low, high`` identify the set."""
    signed = _located(documents).mapInArrow(
        lambda batches: _sign(batches, words),
        "doc_id bigint, raw bigint, n_shingles bigint, low bigint, high bigint, bands array<bigint>",
    )
    return staged(signed.select(F.monotonically_increasing_id().alias("row"), "*"), "minmax-signatures")


def _sets(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = flat(batch.column("text"))
        for start, end in row_slices(offsets, SLICE):
            part = data[offsets[start] : offsets[end]]
            values, borders = shingles(part, offsets[start : end + 1] - offsets[start], words)
            sets = [values[borders[k] : borders[k + 1]].tobytes() for k in range(end - start)]
            rough = [row.tobytes() for row in sketches(values, borders)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("node").slice(start, end - start), pa.array(sets, pa.binary()), pa.array(rough, pa.binary())],
                names=["node", "members", "sketch"],
            )


def _confirm(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Rows come by hub and slice, the hub's own set first; pairs of enough similarity pass."""
    hub, held = None, None
    for batch in batches:
        a, b = batch.column("a").to_numpy(), batch.column("b").fill_null(-1).to_numpy()
        members = batch.column("members")
        passed = np.zeros(len(a), bool)
        for k in range(len(a)):
            values = np.frombuffer(members[k].as_buffer(), np.uint64)
            if b[k] < 0:
                hub, held = a[k], values.copy()
            elif hub == a[k]:
                few, many = (values, held) if len(values) < len(held) else (held, values)
                at = np.minimum(np.searchsorted(many, few), len(many) - 1)
                common = int((many[at] == few).sum())
                passed[k] = 100 * common >= percent * (len(few) + len(many) - common)
        yield batch.select(["a", "b"]).filter(pa.array(passed))


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` whose full sets are similar enough. Both ends meet in slices of a hub."""
    sliced = staged(pairs, "minmax-pairs").withColumn("slice", F.pmod(F.xxhash64("b"), F.lit(HUB_SLICES)))
    of_hub = sliced.select("a", "slice").distinct().join(sets, F.col("a") == F.col("node")).drop("sketch")
    of_member = sliced.join(sets, F.col("b") == F.col("node")).drop("sketch")
    columns = ["a", "slice", "b", "members"]
    return (
        of_hub.withColumn("b", F.lit(None).cast("bigint"))
        .select(columns)
        .unionByName(of_member.select(columns))
        .repartition("a", "slice")
        .sortWithinPartitions("a", "slice", F.col("b").asc_nulls_first())
        .mapInArrow(lambda batches: _confirm(batches, percent), "a bigint, b bigint")
    )


def _suggest(batches: Iterator[pa.RecordBatch], percent: int, best: int) -> Iterator[pa.RecordBatch]:
    """Pairs of a block in different components that look similar: all, or each member's ``best``."""
    for group in grouped(batches, ["bucket", "i", "j"]):
        column = {c: group.column(c).to_numpy() for c in ("node", "label", "size", "part")}
        node, label, size, part = column.values()
        band, i, j = (group.column(c)[0].as_py() for c in ("band", "i", "j"))
        rough = np.frombuffer(b"".join(group.column("sketch").to_pylist()), np.uint8).reshape(len(node), -1)
        bands = group.column("bands").combine_chunks().flatten().to_numpy().reshape(len(node), BANDS)[:, :band]
        _, place, counts = np.unique(label, return_inverse=True, return_counts=True)
        outside = place != counts.argmax() if best and counts.max() > 1 else np.ones(len(node), bool)
        found_a, found_b = [], []
        for x in np.flatnonzero(outside):
            other = (label != label[x]) & ((part == j if part[x] == i else part == i) if i != j else True)
            other &= 100 * np.minimum(size, size[x]) >= percent * np.maximum(size, size[x])
            if not best:
                other &= node > node[x]
            y = np.flatnonzero(other)
            y = y[~(bands[y] == bands[x]).any(axis=1)]
            if not len(y):
                continue
            alike = (rough[y] == rough[x]).mean(axis=1)
            near = np.flatnonzero(alike >= percent / 100 - MARGIN)
            if best:
                near = near[np.argsort(-alike[near], kind="stable")[:best]]
            found_a.append(np.full(len(near), node[x]))
            found_b.append(node[y[near]])
        if found_a:
            a, b = np.concatenate(found_a), np.concatenate(found_b)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"]
            )


def _suggested(members: DataFrame, labels: DataFrame, signed: DataFrame, sets: DataFrame, percent: int, best: int) -> DataFrame:
    """``a, b``: pairs to confirm, from the buckets that hold several components."""
    labelled = members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    mixed = (
        labelled.groupBy("bucket")
        .agg(F.count(F.lit(1)).alias("n"), F.min("label").alias("least"), F.max("label").alias("most"))
        .where("least <> most")
        .select("bucket", F.ceil(F.col("n") / BLOCK).cast("int").alias("parts"))
    )
    tasks = F.transform(
        F.sequence(F.lit(0), F.col("parts") - 1),
        lambda k: F.struct(F.least("part", k).alias("i"), F.greatest("part", k).alias("j")),
    )
    rows = (
        labelled.join(mixed, "bucket")
        .withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
        .withColumn("task", F.explode(tasks))
        .join(signed.select(F.col("row").alias("node"), "bands"), "node")
        .join(sets.select("node", "sketch"), "node")
        .select("bucket", "task.i", "task.j", "band", "node", "label", "size", "part", "bands", "sketch")
    )
    return (
        rows.repartition("bucket", "i", "j")
        .sortWithinPartitions("bucket", "i", "j")
        .mapInArrow(lambda batches: _suggest(batches, percent, best), "a bigint, b bigint")
        .distinct()
    )


def links(signed: DataFrame, classes: DataFrame, documents: DataFrame, words: int, percent: int) -> DataFrame:
    """``node, label``: components of the classes that are linked."""
    reps = signed.join(classes.select("row"), "row")
    entries = reps.select(
        F.col("row").alias("node"), F.col("n_shingles").alias("size"), F.posexplode("bands").alias("band", "value")
    ).select("node", "size", "band", F.xxhash64("band", "value").alias("bucket"))
    crowded = (
        entries.groupBy("bucket")
        .agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("node", "size")).alias("hub"))
        .where("n > 1")
        .select("bucket", F.col("hub.node").alias("hub"), F.col("hub.size").alias("hub_size"))
    )
    members = staged(entries.join(crowded, "bucket"), "minmax-members")
    located = signed.join(members.select(F.col("node").alias("row")).distinct(), "row").select(
        F.col("row").alias("node"), F.col("doc_id").alias("at_id"), F.col("raw").alias("at_raw")
    )
    sets = staged(
        _located(documents)
        .join(located, F.col("doc_id").eqNullSafe(F.col("at_id")) & (F.col("raw") == F.col("at_raw")))
        .select("node", "text")
        .mapInArrow(lambda batches: _sets(batches, words), "node bigint, members binary, sketch binary")
        .dropDuplicates(["node"]),
        "minmax-sets",
    )
    possible = 100 * F.least("size", "hub_size") >= percent * F.greatest("size", "hub_size")
    stars = members.where((F.col("node") != F.col("hub")) & possible).select(
        F.col("hub").alias("a"), F.col("node").alias("b")
    )
    found = staged(confirmed(stars.distinct(), sets, percent), "minmax-links")
    labels = connected(found)
    for best in (BEST, 0):
        more = confirmed(_suggested(members, labels, signed, sets, percent, best), sets, percent)
        found = found.unionByName(staged(more, "minmax-links"))
        labels = connected(found)
    return labels


def near_duplicates(documents: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """``row, doc_id, raw, n_shingles, component_id, kept``, one row per document."""
    signed = signatures(documents, words)
    classes = staged(
        signed.where("n_shingles > 0")
        .groupBy("low", "high", "n_shingles")
        .agg(F.min("doc_id").alias("first_id"), F.min("row").alias("row")),
        "minmax-classes",
    )
    labels = links(signed, classes, documents, words, percent)
    labelled = classes.join(labels, F.col("row") == F.col("node"), "left").select(
        "low", "high", "n_shingles", "first_id", F.coalesce("label", "row").alias("label")
    )
    firsts = labelled.groupBy("label").agg(F.min("first_id").alias("component_id"))
    found = labelled.join(firsts, "label").select("low", "high", "n_shingles", "component_id")
    linked = signed.drop("bands").where("n_shingles > 0").join(found, ["low", "high", "n_shingles"])
    alone = signed.drop("bands").where("n_shingles = 0").withColumn("component_id", F.col("doc_id"))
    return linked.unionByName(alone).select(
        "row",
        "doc_id",
        "raw",
        "n_shingles",
        "component_id",
        F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()).alias("kept"),
    )


def dedup(documents: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The documents that are kept, with their columns."""
    kept = near_duplicates(documents, words, percent).where("kept").select("doc_id", "raw").distinct()
    whole = documents.select(F.struct("*").alias("document"), F.xxhash64("text").alias("hash"))
    return whole.join(
        kept,
        F.col("document.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("hash") == F.col("raw")),
        "left_semi",
    ).select("document.*")
