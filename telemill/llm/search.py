"""Exact top-k search by inner product, block at a time.

Candidates are packed into shards (see ``dense``); inside a shard, sorted by id, every ``BLOCK_ROWS`` rows
form a document-range block with the maximum and minimum of each component. For a query q the sum over
components of ``max(q_d * max_d, q_d * min_d)`` bounds every score of a block from above. A query orders
the blocks of a shard by that bound and scores them through their forward index (the block's rows) until
the next bound falls below its k-th score; a bound equal to it is still read, as a tie may go to a smaller
id. Each unit leaves at most k rows a query; a window over those (k times the shards) gives the k best.

Semantics: queries are the distinct (vec_id, vector) rows with ``vec_id % every == 0``; candidates are all
rows of the same length whose id differs from the query's (a null id differs from all and sorts after
every id). Rows with a null vector or a null or non-finite component take no part. Ties of score go to
the smaller id; rows with equal id and score are equal in order. Empty table: no rows.
"""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from telemill.llm import dense

FOUND = "query_id long, query_tag long, vec_id long, score long"


def _bounds(queries: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Upper bounds of the scores of each query in each block, exact in 64-bit integers."""
    plus, minus = np.maximum(queries, 0), np.minimum(queries, 0)
    return plus @ high.T + minus @ low.T


def _search_unit(row, k: int, block_rows: int) -> list[tuple]:
    q, c = dense.unpack(row, "q"), dense.unpack(row, "c")
    if not q["n"] or not c["n"]:
        return []
    starts = np.arange(0, c["n"], block_rows)
    high = np.maximum.reduceat(c["comps"], starts, axis=0)
    low = np.minimum.reduceat(c["comps"], starts, axis=0)
    bounds = _bounds(q["comps"], high, low)
    c_ids = c["ids"]
    out = []
    for i in range(q["n"]):
        own = q["ids"][i] if q["has_id"][i] else None
        top_scores = np.zeros(0, np.int64)
        top_at = np.zeros(0, np.int64)
        for b in np.argsort(-bounds[i], kind="stable"):
            if len(top_scores) == k and bounds[i, b] < top_scores[-1]:
                break
            at = np.arange(starts[b], min(starts[b] + block_rows, c["n"]))
            if own is not None:
                at = at[~(c["has_id"][at] & (c_ids[at] == own))]
            scores = dense.inner(c["comps"][at], q["comps"][i : i + 1])[:, 0]
            pool_scores = np.concatenate([top_scores, scores])
            pool_at = np.concatenate([top_at, at])
            keep = dense.first(pool_scores, c_ids[pool_at], k)
            top_scores, top_at = pool_scores[keep], pool_at[keep]
        for s, j in zip(top_scores, top_at):
            out.append((own, int(q["tags"][i]), int(c_ids[j]) if c["has_id"][j] else None, int(s)))
    return out


def top_k(embeddings: DataFrame, k: int = 5, every: int = 50, scale: int = 256, block_rows: int = dense.BLOCK_ROWS) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the ``k`` best candidates of every query (all, if fewer)."""
    vectors = dense.integer_vectors(embeddings, scale)
    queries = vectors.where(F.col("vec_id") % every == 0).dropDuplicates(["vec_id", "comps"])
    batches, _ = dense.packed(queries, dense.BATCH_QUERIES, "search-queries")
    shards, n_shards = dense.packed(vectors, dense.SHARD_ROWS, "search-shards")

    def search(frames):
        for frame in frames:
            rows = [r for _, row in frame.iterrows() for r in _search_unit(row, k, block_rows)]
            yield pd.DataFrame(rows, columns=["query_id", "query_tag", "vec_id", "score"])

    found = dense.units(batches, shards, n_shards).mapInPandas(search, FOUND)
    order = Window.partitionBy("query_id", "query_tag").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int"), "vec_id", "score")
