"""Hard negatives, top-k search and centroid clustering against plain versions of their rules."""

import hashlib
import math
import random

import numpy as np
import pytest

from telemill.llm import centroids, negatives, search

SCHEMA = "vec_id bigint, embedding array<float>, label int, comps string, score double, tag string"


def vector_rows(n=260, dims=8, seed=5):
    """Vectors with ties, repeats, nulls, non-finite parts, other lengths and clashing extra columns."""
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        vec = [rng.choice([-1.0, -0.5, 0.0, 0.25, 0.5, 1.0]) * rng.random() for _ in range(dims)]
        rows.append((k, vec, rng.randrange(4), "x", 1.0, "t"))
    rows += [
        (1000, [0.5] * dims, 1, "x", 1.0, "t"),
        (1001, [0.5] * dims, 2, "x", 1.0, "t"),  # a tie of score with 1000
        (1002, None, 1, "x", 1.0, "t"),
        (1003, [0.1] * (dims - 1) + [None], 1, "x", 1.0, "t"),
        (1004, [0.1] * (dims - 1) + [float("nan")], 1, "x", 1.0, "t"),
        (1005, [0.1] * (dims - 1) + [float("inf")], 1, "x", 1.0, "t"),
        (1006, [0.3] * dims, None, "x", 1.0, "t"),
        (1007, [0.2] * (dims + 1), 1, "x", 1.0, "t"),
        (None, [0.4] * dims, 3, "x", 1.0, "t"),
        (1100, [0.0] * dims, 0, "x", 1.0, "t"),
        (1200, [0.7] * dims, 2, "x", 1.0, "t"),
    ]
    rows += rows[10:14]  # repeated rows
    return rows


def integer(rows, scale, dims=None):
    found = []
    for vec_id, vec, label, *_ in rows:
        if vec is None or any(x is None or not math.isfinite(x) for x in vec) or (dims and len(vec) != dims):
            continue
        found.append((vec_id, label, [math.floor(scale * float(np.float32(x))) for x in vec]))
    return found


def key(vec_id):
    return (vec_id is None, vec_id if vec_id is not None else 0)


def plain_search(rows, k=5, every=50):
    vectors = integer(rows, 256)
    queries = {(i, tuple(c)) for i, _, c in vectors if i is not None and i % every == 0}
    found = []
    for qid, qc in queries:
        scored = [(sum(a * b for a, b in zip(qc, c)), i) for i, _, c in vectors if i != qid and len(c) == len(qc)]
        scored.sort(key=lambda s: (-s[0], key(s[1])))
        found += [(qid, r, i, s) for r, (s, i) in enumerate(scored[:k], 1)]
    return sorted(found, key=str)


def plain_negatives(rows, every=100):
    vectors = [(i, (lab + 1) % 10 if i is not None and i % 7 == 0 else lab, c) for i, lab, c in integer(rows, 256) if lab is not None]
    anchors = {(i, lab, tuple(c)) for i, lab, c in vectors if i is not None and i % every == 0}
    found = []
    for aid, alab, ac in anchors:
        scored = [(sum(a * b for a, b in zip(ac, c)), i, lab) for i, lab, c in vectors if i != aid and len(c) == len(ac)]
        scored.sort(key=lambda s: (-s[0], key(s[1])))
        for ps, pid, _ in [s for s in scored if s[2] == alab][:5]:
            window = [s for s in scored if s[2] != alab and 80 * ps <= 100 * s[0] <= 100 * ps][:5]
            found += [(aid, pid, r, nid, ps, ns) for r, (ns, nid, _) in enumerate(window, 1)]
    return sorted(found, key=str)


def plain_clusters(rows, k=16, rounds=3, dims=8, scale=64):
    vectors = integer(rows, scale, dims)
    if not vectors:
        return []
    digest = lambda i: hashlib.sha256(f"1:{i}".encode()).hexdigest() if i is not None else "~"
    first = sorted(vectors, key=lambda v: (digest(v[0]), v[2]))[:k]
    cents = [list(c) for _, _, c in first]
    x = [c for _, _, c in vectors]

    def assign():
        out = []
        for v in x:
            d = [sum((a - b) ** 2 for a, b in zip(v, c)) for c in cents]
            out.append((d.index(min(d)), min(d)))
        return out

    for _ in range(rounds):
        at = assign()
        for c in range(len(cents)):
            mine = [x[i] for i, (a, _) in enumerate(at) if a == c]
            if mine:
                cents[c] = [sum(col) // len(mine) for col in zip(*mine)]
    at = assign()
    per = {c: sum(d for a, d in at if a == c) for c in range(len(cents))}
    total = sum(per.values())
    sha = lambda c: hashlib.sha256(",".join(map(str, cents[c])).encode()).hexdigest()
    return sorted(((v[0], a, d, per[a], total, sha(a)) for v, (a, d) in zip(vectors, at)), key=str)


@pytest.fixture(scope="module")
def vectors(spark):
    return spark.createDataFrame(vector_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def no_vectors(spark):
    return spark.createDataFrame([], SCHEMA)


def collected(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


def test_search(vectors, no_vectors):
    want = plain_search(vector_rows())
    assert collected(search.top_k(vectors, every=50)) == want
    assert collected(search.top_k(vectors, every=50, block_rows=4)) == want
    assert search.top_k(no_vectors).count() == 0


def test_search_prunes_blocks_without_losing_ties(spark):
    """Many equal vectors: every bound equals the k-th score, so ties must still be read."""
    rows = [(k, [0.5, 0.5], 0, "x", 1.0, "t") for k in range(1, 400)] + [(0, [0.5, 0.5], 0, "x", 1.0, "t")]
    frame = spark.createDataFrame(rows, SCHEMA)
    assert collected(search.top_k(frame, every=50, block_rows=8)) == plain_search(rows)


def test_units_are_not_gathered_on_the_driver(vectors):
    """The batches come once a shard: a broadcast would bring that product to the driver, whatever its estimate."""
    for found in (search.top_k(vectors), negatives.mine(vectors)):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "BroadcastHashJoin [q_dims" not in plan and "BroadcastNestedLoop" not in plan


def test_negatives(vectors, no_vectors):
    assert collected(negatives.mine(vectors, anchor_every=100)) == plain_negatives(vector_rows())
    assert collected(negatives.mine(vectors, anchor_every=20)) == plain_negatives(vector_rows(), every=20)
    assert negatives.mine(no_vectors).count() == 0


def test_clusters(vectors, no_vectors):
    assert collected(centroids.clusters(vectors, dims=8, k=16)) == plain_clusters(vector_rows())
    assert collected(centroids.clusters(vectors, dims=8, k=300)) == plain_clusters(vector_rows(), k=300)
    assert centroids.clusters(no_vectors, dims=8).count() == 0


def test_vantage_tree_is_exact_with_ties():
    rng = np.random.default_rng(1)
    points = rng.integers(-3, 4, size=(40, 5))
    points[7] = points[3]  # equal centroids: the smaller number wins
    tree = centroids.VantageTree(points)
    for q in rng.integers(-4, 5, size=(500, 5)):
        d = ((points - q) ** 2).sum(axis=1)
        assert tree.nearest(q) == (int(d.argmin()), int(d.min()))
