"""Centroid clustering with a vantage-point tree over the centroids.

Each round the driver builds a vantage-point tree over the current centroids (k of them, a parameter, so
the tree's size is bounded) and broadcasts it. Every vector finds its nearest centroid by best-first
branch and bound: subtrees wait in a heap by a lower bound on their distance (|d(q, v) - mu| by the
triangle inequality); one whose bound exceeds the best distance found is pruned, one whose bound equals it
is still searched (inclusive radius), since a tie goes to the smaller centroid number. Distances at the
leaves are exact squared distances in integers; only the bounds use square roots, with a margin, so
rounding never prunes a candidate. Tasks add up the vectors of each centroid before the shuffle (k rows a
task); the driver takes k sums, so the update is an exact floor of sum over count.

Semantics: vectors of exactly ``dims`` components, none null or non-finite, each as ``floor(scale * x)``;
others take no part. The first centroids are the k kept rows with the smallest sha256 of ``1:<vec_id>``
(then by vector; a null id has no hash and comes last); fewer rows give fewer centroids. Repeated rows are
vectors of their own. Empty centroids stay. Empty table: no rows.
"""

import hashlib
import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telemill.llm import dense
from telemill.llm.staging import staged

SUMS = "cluster int, n long, sums array<long>"
ASSIGNED = "vec_id long, cluster int, distance long"


class VantageTree:
    """A vantage-point tree over integer points; ``nearest`` is exact, ties to the smaller point number."""

    def __init__(self, points: np.ndarray):
        self.points = np.asarray(points, dtype=np.int64)
        self.nodes = []  # (point, radius, inside node, outside node)
        self.root = self._build(list(range(len(self.points))))

    def _build(self, members: list[int]) -> int:
        if not members:
            return -1
        vantage, rest = members[0], members[1:]
        if not rest:
            self.nodes.append((vantage, 0.0, -1, -1))
            return len(self.nodes) - 1
        gaps = self.points[rest] - self.points[vantage]
        far = np.sqrt((gaps * gaps).sum(axis=1).astype(np.float64))
        radius = float(np.median(far))
        inside = [m for m, d in zip(rest, far) if d <= radius]
        outside = [m for m, d in zip(rest, far) if d > radius]
        at = len(self.nodes)
        self.nodes.append(None)
        self.nodes[at] = (vantage, radius, self._build(inside), self._build(outside))
        return at

    def nearest(self, q: np.ndarray) -> tuple[int, int]:
        best, best_d2 = -1, -1
        heap = [(0.0, self.root)]
        while heap:
            bound, node = heapq.heappop(heap)
            if node < 0:
                continue
            if best >= 0 and bound > math.sqrt(best_d2) * (1 + 1e-12) + 1e-9:
                break
            vantage, radius, inside, outside = self.nodes[node]
            gap = self.points[vantage] - q
            d2 = int(gap @ gap)
            if best < 0 or d2 < best_d2 or (d2 == best_d2 and vantage < best):
                best, best_d2 = vantage, d2
            d = math.sqrt(d2)
            heapq.heappush(heap, (max(bound, d - radius), inside))
            heapq.heappush(heap, (max(bound, radius - d), outside))
        return best, best_d2


def _vectors(frame: pd.DataFrame, dims: int) -> np.ndarray:
    return np.array(frame["comps"].tolist(), dtype=np.int64).reshape(len(frame), dims)


def _sums(tree: VantageTree, dims: int):
    def run(frames):
        for frame in frames:
            points = _vectors(frame, dims)
            found = np.array([tree.nearest(p)[0] for p in points], dtype=np.int64)
            rows = []
            for c in np.unique(found):
                mine = points[found == c]
                rows.append((int(c), len(mine), [int(x) for x in mine.sum(axis=0)]))
            yield pd.DataFrame(rows, columns=["cluster", "n", "sums"])

    return run


def _assigned(tree: VantageTree, dims: int):
    def run(frames):
        for frame in frames:
            found = [tree.nearest(p) for p in _vectors(frame, dims)]
            yield pd.DataFrame(
                {
                    "vec_id": frame["vec_id"].astype("Int64"),
                    "cluster": pd.Series([c for c, _ in found], dtype="int32"),
                    "distance": pd.Series([d for _, d in found], dtype="int64"),
                }
            )

    return run


def _updated(vectors: DataFrame, centroids: list[list[int]], dims: int) -> list[list[int]]:
    spark = vectors.sparkSession
    tree = spark.sparkContext.broadcast(VantageTree(np.array(centroids)))
    partial = vectors.mapInPandas(lambda frames: _sums(tree.value, dims)(frames), SUMS)
    summed = (
        partial.select("cluster", "n", F.posexplode("sums").alias("d", "s"))
        .groupBy("cluster", "d")
        .agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
        .collect()
    )
    tree.unpersist()
    fresh = [list(c) for c in centroids]
    for row in summed:
        fresh[row["cluster"]][row["d"]] = row["s"] // row["n"]
    return fresh


def clusters(embeddings: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every kept vector."""
    vectors = staged(dense.integer_vectors(embeddings, scale, dims).select("vec_id", "comps"), "cluster-vectors")
    key = F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256)
    first = vectors.orderBy(key.asc_nulls_last(), F.col("comps").asc()).limit(k).collect()
    centroids = [list(r["comps"]) for r in first]
    if not centroids:
        return vectors.select(
            "vec_id",
            F.lit(0).alias("cluster"),
            F.lit(0).cast("long").alias("distance"),
            F.lit(0).cast("long").alias("cluster_inertia"),
            F.lit(0).cast("long").alias("inertia"),
            F.lit("").alias("centroid_sha256"),
        )
    for _ in range(rounds):
        centroids = _updated(vectors, centroids, dims)
    spark = vectors.sparkSession
    tree = spark.sparkContext.broadcast(VantageTree(np.array(centroids)))
    assigned = staged(vectors.mapInPandas(lambda frames: _assigned(tree.value, dims)(frames), ASSIGNED), "cluster-assigned")
    per_cluster = {r["cluster"]: r["total"] for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("total")).collect()}
    digests = [hashlib.sha256(",".join(str(int(x)) for x in c).encode()).hexdigest() for c in centroids]
    by_cluster = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), F.col("cluster") + 1)
    return assigned.select(
        "vec_id",
        "cluster",
        "distance",
        by_cluster([int(per_cluster.get(c, 0)) for c in range(len(centroids))]).cast("long").alias("cluster_inertia"),
        F.lit(int(sum(per_cluster.values()))).cast("long").alias("inertia"),
        by_cluster(digests).alias("centroid_sha256"),
    )
