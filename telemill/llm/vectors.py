"""Embedding near-dedup by lattice hashing.

In each of ``TABLES`` tables a vector of length one is projected at random to ``BLOCKS`` times eight
dimensions, and every eight are decoded to the nearest point of the lattice E8; the points together
are the vector's cell. A vector also probes the cells with one block moved to one of the ``PROBES``
nearest neighbours of its point. Two vectors meet if one owns a cell that the other owns or probes;
at cosine 0.95 a table brings them together with a chance of 0.3, so all tables fail with 2e-4.
Links are confirmed by cosine in double precision.

Equal vectors form one class and are counted, not paired. Cells that hold one class are left out before
any vector is sent. In a cell the classes are compared block by block inside a task, the many small cells
of a batch in one step; what leaves the task is one row per class: its number of links and a class it is
connected with. A pair that meets in
several cells is counted in the first one only (its cells are worked out again for that), so counts
are exact without listing pairs. Large cells are divided into blocks of ``BLOCK`` classes.

Nulls and ties: vectors that are null, zero, or hold a null or non-finite component link with nothing
and are kept. Vectors of different lengths are never linked. Repeated rows are vectors of their own,
linked with each other. A null id is no candidate for the smallest id. Labels and other columns are
ignored.
"""

from collections.abc import Iterator
from functools import lru_cache, reduce
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telemill.llm.components import connected
from telemill.llm.groups import whole_groups
from telemill.llm.staging import staged
from telemill.llm.text import mix

TABLES = 24
BLOCKS = 2
PROBES = 2
SCALE = 0.6
BLOCK = 1024
PAIRS_AT_ONCE = 1 << 17
ROWS_AT_ONCE = 8192
#: A group in which an owner meets more rows is a matrix product; of smaller ones so many values are compared at once.
LARGE = 64
VALUES_AT_ONCE = 1 << 21
RECENT = 20_000
_STEP = np.uint64(0xD6E8FEB86659FD93)


def _shortest() -> np.ndarray:
    """The 240 shortest vectors of E8: two ones of any sign, or all halves with evenly many minus."""
    pairs = [
        [s if k == i else t if k == j else 0.0 for k in range(8)]
        for i in range(8) for j in range(i) for s in (1, -1) for t in (1, -1)
    ]
    halves = [v for v in product((0.5, -0.5), repeat=8) if sum(x < 0 for x in v) % 2 == 0]
    return np.array(pairs + [list(v) for v in halves])


SHORTEST = _shortest()


def _even_integers(x: np.ndarray) -> np.ndarray:
    """Nearest integer points with an even sum."""
    point = np.rint(x)
    gap = x - point
    odd = np.flatnonzero(point.sum(axis=1) % 2)
    worst = np.abs(gap[odd]).argmax(axis=1)
    point[odd, worst] += np.where(gap[odd, worst] >= 0, 1, -1)
    return point


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """E8 is the even integer points together with those moved by one half in every coordinate."""
    whole, half = _even_integers(x), _even_integers(x - 0.5) + 0.5
    closer = ((x - whole) ** 2).sum(axis=1) <= ((x - half) ** 2).sum(axis=1)
    return np.where(closer[:, None], whole, half)


def _point_hash(points: np.ndarray) -> np.ndarray:
    value = np.zeros(len(points), np.uint64)
    for k in range(8):
        value = value * _STEP + (2 * points[:, k]).astype(np.int64).view(np.uint64)
    return mix(value)


@lru_cache(maxsize=4 * TABLES)
def _frame(size: int, table: int) -> np.ndarray:
    return np.random.default_rng([size, table]).normal(0, SCALE, (size, 8 * BLOCKS))


def cells(x: np.ndarray) -> np.ndarray:
    """Cells of vectors of length one: ``[vector, table, 1 + BLOCKS * PROBES]``, the own one first."""
    n, size = x.shape
    found = np.empty((n, TABLES, 1 + BLOCKS * PROBES), np.int64)
    for t in range(TABLES):
        projected = x @ _frame(size, t)
        own, moved = [], []
        for k in range(BLOCKS):
            part = projected[:, 8 * k : 8 * k + 8]
            point = nearest_e8(part)
            along = (part - point) @ SHORTEST.T
            own.append(_point_hash(point))
            moved.append([])
            for _ in range(PROBES):
                best = along.argmax(axis=1)
                along[np.arange(n), best] = -np.inf
                moved[k].append(_point_hash(point + SHORTEST[best]))
        variants = [own] + [
            [moved[k][p] if b == k else own[b] for b in range(BLOCKS)] for k in range(BLOCKS) for p in range(PROBES)
        ]
        for v, hashes in enumerate(variants):
            value = np.full(n, mix(np.array([size * TABLES + t], np.uint64))[0])
            for h in hashes:
                value = mix(value * _STEP + h)
            found[:, t, v] = value.view(np.int64)
    return found


def _matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Flat values in double precision and the length of each vector."""
    lengths = np.diff(column.offsets.to_numpy())
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64), lengths.astype(np.int64)


def _by_length(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    values, lengths = _matrix(column)
    starts = np.cumsum(lengths) - lengths
    for size in np.unique(lengths):
        at = np.flatnonzero(lengths == size)
        yield at, values[starts[at][:, None] + np.arange(size)]


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    width = 1 + BLOCKS * PROBES
    for batch in batches:
        nodes = batch.column("node").to_numpy()
        for at, x in _by_length(batch.column("embedding")):
            for start in range(0, len(at), 2048):
                some = at[start : start + 2048]
                found = cells(_unit(x[start : start + 2048]))
                tables = np.tile(np.repeat(np.arange(TABLES, dtype=np.int32), width), len(some))
                own = np.tile(np.arange(width) == 0, len(some) * TABLES)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(found.ravel()),
                        pa.array(tables),
                        pa.array(np.repeat(nodes[some], TABLES * width)),
                        pa.array(own),
                    ],
                    names=["cell", "table", "node", "own"],
                )


#: Of one task at a time: class numbers are those of one run.
_recent: dict[int, np.ndarray] = {}


def _cells_of(nodes: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Cells of some classes, which mostly come again in other cells of the same task."""
    if len(_recent) > RECENT:
        _recent.clear()
    new = np.array([node not in _recent for node in nodes.tolist()])
    if new.any():
        _recent.update(zip(nodes[new].tolist(), cells(x[new]), strict=True))
    return np.stack([_recent[node] for node in nodes.tolist()])


def _visits(owner: np.ndarray, visitor: np.ndarray) -> np.ndarray:
    """For each pair, whether the visitor's cells of one table hold the owner's own cell."""
    return (owner[:, :1] == visitor).any(axis=1)


def _first_time(known: np.ndarray, a: np.ndarray, b: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The pairs that meet in no table before their own; most fall out after one or two tables."""
    rest, done = np.arange(len(a)), []
    for t in range(TABLES):
        reached = table[rest] == t
        done.append(rest[reached])
        rest = rest[~reached]
        if not len(rest):
            break
        x, y = known[a[rest], t], known[b[rest], t]
        rest = rest[~(_visits(x, y) | _visits(y, x))]
    return np.sort(np.concatenate(done))


def _close_pairs(group, nodes, own, owner, visitor, unit, cosine) -> tuple[np.ndarray, np.ndarray]:
    """Owner and visitor of each close pair of one group; ``group`` numbers the rows' groups, ascending.

    Many small groups are compared in one step, their pairs written out; a large group is a matrix product.
    Two owners of a cell meet twice, and count from the smaller class only.
    """
    pairs_a, pairs_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]

    def add(a, b):
        differ = (nodes[a] < nodes[b]) | ((nodes[a] > nodes[b]) & ~own[b])
        pairs_a.append(a[differ])
        pairs_b.append(b[differ])

    owners, visitors = np.flatnonzero(owner), np.flatnonzero(visitor)
    first = np.searchsorted(group[visitors], group[owners], "left")
    met = np.searchsorted(group[visitors], group[owners], "right") - first
    large = np.unique(group[owners[met > LARGE]])
    for g in large.tolist():
        of, to = owners[group[owners] == g], visitors[group[visitors] == g]
        for start in range(0, len(of), BLOCK):
            some = of[start : start + BLOCK]
            for at in range(0, len(to), BLOCK):
                a, b = np.nonzero(unit[some] @ unit[to[at : at + BLOCK]].T >= cosine)
                add(some[a], to[at + b])
    small = met <= LARGE
    owners, first, met = owners[small], first[small], met[small]
    ends = np.cumsum(met)
    start, at_once = 0, VALUES_AT_ONCE // unit.shape[1]
    while start < len(owners):
        done = ends[start] - met[start]
        end = max(start + 1, int(np.searchsorted(ends, done + at_once, "right")))
        a = np.repeat(owners[start:end], met[start:end])
        step = np.arange(len(a)) - np.repeat(ends[start:end] - met[start:end] - done, met[start:end])
        b = visitors[np.repeat(first[start:end], met[start:end]) + step]
        differ = (nodes[a] < nodes[b]) | ((nodes[a] > nodes[b]) & ~own[b])
        a, b = a[differ], b[differ]
        close = np.einsum("ij,ij->i", unit[a], unit[b]) >= cosine
        add(a[close], b[close])
        start = end
    return np.concatenate(pairs_a), np.concatenate(pairs_b)


def _compare(group, nodes, own, owner, visitor, table, sizes, vectors, cosine) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Blocks of cells: nodes with links counted here, the smallest node each is connected with in its block,
    and the number of vectors it links with. A block may hold visitors only, or owners only."""
    unit = _unit(vectors)
    a, b = _close_pairs(group, nodes, own, owner, visitor, unit, cosine)
    if not len(a):
        return (np.zeros(0, np.int64),) * 3
    _, at, place = np.unique(nodes[np.r_[a, b]], return_index=True, return_inverse=True)
    at = np.r_[a, b][at]
    known = _cells_of(nodes[at], unit[at])
    place_a, place_b = place[: len(a)], place[len(a) :]
    counted = []
    for start in range(0, len(a), PAIRS_AT_ONCE):
        end = start + PAIRS_AT_ONCE
        rest = start + _first_time(known, place_a[start:end], place_b[start:end], table[a[start:end]])
        # Of the two cells of one table the smaller class's own counts.
        here = table[a[rest]]
        backward = _visits(known[place_b[rest], here], known[place_a[rest], here])
        counted.append(rest[(nodes[a[rest]] < nodes[b[rest]]) | ~backward])
    counted = np.concatenate(counted)
    a, b = a[counted], b[counted]
    count = np.bincount(a, sizes[b], len(nodes)) + np.bincount(b, sizes[a], len(nodes))
    # No pair goes from one block to another, so the labels stay within theirs.
    label = nodes.copy()
    while True:
        least = np.minimum(label[a], label[b])
        smaller = label.copy()
        np.minimum.at(smaller, a, least)
        np.minimum.at(smaller, b, least)
        if (smaller == label).all():
            break
        label = smaller
    linked = np.unique(np.r_[a, b])
    # A class may be in a cell twice, as owner and by a probe: its rows are summed later.
    return nodes[linked], label[linked], count[linked].astype(np.int64)


def _meet(batches: Iterator[pa.RecordBatch], cosine: float) -> Iterator[pa.RecordBatch]:
    """Rows come by cell and block; a group may go over several batches."""
    keys = ["cell", "i", "j"]

    def judged(groups: pa.Table) -> Iterator[pa.RecordBatch]:
        column = {name: groups.column(name).to_numpy() for name in groups.column_names if name != "embedding"}
        changes = reduce(np.logical_or, [np.diff(column[k]) != 0 for k in keys])
        group = np.r_[0, np.cumsum(changes)]
        owner = column["own"] & (column["part"] == column["i"])
        visitor = column["part"] == column["j"]
        # Only blocks with both an owner and a visitor have pairs.
        n = int(group[-1]) + 1
        has = (np.bincount(group, owner, n) > 0) & (np.bincount(group, visitor, n) > 0)
        for at, x in _by_length(groups.column("embedding").combine_chunks()):
            at, x = at[has[group[at]]], x[has[group[at]]]
            if len(at):
                found = _compare(
                    group[at], column["node"][at], column["own"][at], owner[at], visitor[at], column["table"][at],
                    column["size"][at], x, cosine,
                )
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], names=["a", "b", "n"])

    _recent.clear()
    for groups in whole_groups(batches, keys, ROWS_AT_ONCE):
        yield from judged(groups)


def class_links(classes: DataFrame, cosine: float) -> DataFrame:
    """Stored ``a, b, n``: links of class ``a`` counted in one cell, and a class ``b`` it is connected with."""
    entries = staged(
        classes.select("node", "embedding").mapInArrow(
            _place, "cell bigint, table int, node bigint, own boolean"
        ),
        "vector-cells",
    )
    shared = (
        entries.groupBy("cell")
        .agg(F.count(F.lit(1)).alias("n"), F.max("own").alias("owned"))
        .where("n > 1 AND owned")
        .select("cell", F.ceil(F.col("n") / BLOCK).cast("int").alias("parts"))
    )
    every = F.sequence(F.lit(0), F.col("parts") - 1)
    blocks = F.concat(
        F.transform(every, lambda k: F.struct(F.col("part").alias("i"), k.alias("j"))),
        F.transform(every, lambda k: F.struct(k.alias("i"), F.col("part").alias("j"))),
    )
    visits = F.transform(every, lambda k: F.struct(k.alias("i"), F.col("part").alias("j")))
    met = (
        entries.join(shared, "cell")
        .withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
        .withColumn("block", F.explode(F.when(F.col("own"), F.array_distinct(blocks)).otherwise(visits)))
        .select("cell", "table", "node", "own", "part", "block.i", "block.j")
        .join(classes.select("node", "size", "embedding"), "node")
        .repartition("cell", "i", "j")
        .sortWithinPartitions("cell", "i", "j")
    )
    return staged(met.mapInArrow(lambda batches: _meet(batches, cosine), "a bigint, b bigint, n bigint"), "vector-links")


def near_duplicates(embeddings: DataFrame, cosine: float = 0.95) -> DataFrame:
    """``vec_id, n_links, component_id, kept``, one row per vector."""
    vector = F.col("embedding")
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists(vector, lambda x: x != 0)
    rows = embeddings.select(
        "vec_id",
        "embedding",
        F.coalesce(~odd & some, F.lit(False)).alias("usable"),
        F.xxhash64("embedding").alias("k1"),
        F.xxhash64(F.lit(5), "embedding").alias("k2"),
    )
    classes = staged(
        rows.where("usable")
        .groupBy("k1", "k2")
        .agg(F.min("vec_id").alias("first_id"), F.count(F.lit(1)).alias("size"), F.first("embedding").alias("embedding"))
        .select(F.monotonically_increasing_id().alias("node"), "*"),
        "vector-classes",
    )
    found = class_links(classes, cosine)
    labels = connected(found.select("a", "b"))
    counts = found.groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("outer"))
    labelled = (
        classes.drop("embedding")
        .join(labels, "node", "left")
        .join(counts, "node", "left")
        .withColumn("label", F.coalesce("label", "node"))
    )
    firsts = labelled.groupBy("label").agg(F.min("first_id").alias("component_id"))
    judged = labelled.join(firsts, "label").select(
        "k1", "k2", "component_id", (F.coalesce("outer", F.lit(0)) + F.col("size") - 1).alias("n_links")
    )
    linked = rows.where("usable").select("vec_id", "k1", "k2").join(judged, ["k1", "k2"])
    alone = rows.where("NOT usable").select(
        "vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id")
    )
    return linked.select("vec_id", "n_links", "component_id").unionByName(alone).withColumn(
        "kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.col("component_id").isNull())
    )
