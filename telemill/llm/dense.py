"""Integer vectors of ``embeddings`` and the blocks in which a stated query set meets all rows.

A query set that grows with the table (every 50th or 100th id) meets every row; that work is quadratic by
definition, so it is spread over units of (query batch, candidate shard). Candidates are dealt to shards
by a salted hash (a repeated vector is no hot key) and packed, sorted by id, into one row per shard; query
batches are packed alike and sent to every shard of their length. A unit is one row of that join: one
shard and one batch, both of bounded size, so no task holds more than ``SHARD_ROWS`` candidates and
``BATCH_QUERIES`` queries. Packed tables are written to the shared folder, so a lost executor costs its
own units only.

Scores are exact integer inner products: in doubles by BLAS while every product and sum stays below 2**53,
else in 64-bit integers (beyond 2**63 they wrap).
"""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telemill.llm.staging import staged

SHARD_ROWS = 8192
BATCH_QUERIES = 1024
BLOCK_ROWS = 256
#: The sort key of a null id: after every id.
NO_ID = np.iinfo(np.int64).max
NO_LABEL = np.iinfo(np.int64).min

PACKED = (
    "dims int, shard long, n long, ids binary, has_id binary, labels binary, tags binary, extra binary, comps binary"
)


def integer_vectors(embeddings: DataFrame, scale: int, dims: int | None = None) -> DataFrame:
    """vec_id, label, comps: each component x as ``floor(scale * x)`` with x as double, in 64-bit integers.

    Rows whose vector is null or holds a null, NaN or infinite component are left out; with ``dims``, also
    those of another length. Other columns of ``embeddings`` are ignored, whatever their names.
    """
    e = F.col("embedding")
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    ok = e.isNotNull() & finite
    if dims is not None:
        ok = ok & (F.size(e) == dims)
    comps = F.transform(e, lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("long"))
    return embeddings.select("vec_id", "label", "embedding").where(ok).select("vec_id", "label", comps.alias("comps"))


def _pack_group(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
    null = frame["vec_id"].isna().to_numpy()
    frame = frame.assign(_null=null, _id=np.where(null, NO_ID, frame["vec_id"].fillna(0).astype("int64")))
    frame = frame.sort_values(["_null", "_id", "tag"], kind="stable")
    dims = int(key[0])
    comps = np.array(frame["comps"].tolist(), dtype=np.int64).reshape(len(frame), dims)
    extra = np.array(frame["extra"].tolist(), dtype=np.int64) if "extra" in frame else np.zeros((len(frame), 0), np.int64)
    return pd.DataFrame(
        {
            "dims": [dims],
            "shard": [int(key[1])],
            "n": [len(frame)],
            "ids": [frame["_id"].to_numpy(np.int64).tobytes()],
            "has_id": [(~frame["_null"]).to_numpy(np.bool_).tobytes()],
            "labels": [frame["label"].fillna(NO_LABEL).astype("int64").to_numpy().tobytes()],
            "tags": [frame["tag"].astype("int64").to_numpy().tobytes()],
            "extra": [extra.tobytes()],
            "comps": [comps.tobytes()],
        }
    )


def packed(vectors: DataFrame, per_group: int, name: str, extra: str | None = None) -> tuple[DataFrame, int]:
    """One row per (length, group) of about ``per_group`` vectors, sorted by id, and the number of groups.

    The group is a hash of id, vector and a row number: repeated rows spread over groups like any others.
    """
    n = vectors.count()
    groups = max(1, -(-n // per_group))
    salt = F.xxhash64("vec_id", "comps", F.monotonically_increasing_id())
    cols = ["vec_id", "label", "comps", F.xxhash64("label", "comps").alias("tag")]
    if extra:
        cols.append(F.col(extra).alias("extra"))
    keyed = vectors.select(
        *cols, F.size("comps").alias("dims"), F.pmod(salt, F.lit(groups)).alias("shard")
    )
    return staged(keyed.groupBy("dims", "shard").applyInPandas(_pack_group, PACKED), name), groups


def units(queries: DataFrame, candidates: DataFrame, shards: int) -> DataFrame:
    """Each query batch beside each candidate shard of its length: query columns ``q_*``, candidate ``c_*``.

    Always a sort-merge join: Spark takes the batches for as small as their file, although every batch comes
    once a shard here, and would gather that product, which grows with the square of the table, on the driver
    to broadcast it. Shards that were small enough to be broadcast are few in any case.
    """
    q = queries.select(
        *[F.col(c).alias(f"q_{c}") for c in queries.columns],
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("at"),
    )
    c = candidates.select(*[F.col(k).alias(f"c_{k}") for k in candidates.columns])
    return q.hint("merge").join(c.hint("merge"), (q.q_dims == c.c_dims) & (q.at == c.c_shard)).drop("at")


def unpack(row, side: str) -> dict:
    """The arrays of one packed side of a unit row."""
    n, dims = int(row[f"{side}_n"]), int(row[f"{side}_dims"])
    extra = np.frombuffer(row[f"{side}_extra"], np.int64)
    return {
        "n": n,
        "ids": np.frombuffer(row[f"{side}_ids"], np.int64),
        "has_id": np.frombuffer(row[f"{side}_has_id"], np.bool_),
        "labels": np.frombuffer(row[f"{side}_labels"], np.int64),
        "tags": np.frombuffer(row[f"{side}_tags"], np.int64),
        "extra": extra.reshape(n, -1) if n else extra.reshape(0, 0),
        "comps": np.frombuffer(row[f"{side}_comps"], np.int64).reshape(n, dims),
    }


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products of the rows of ``a`` and ``b``: BLAS in doubles where that is exact."""
    if a.size == 0 or b.size == 0:
        return np.zeros((len(a), len(b)), np.int64)
    big = float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1]
    if big < 2.0**52:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def first(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the ``k`` highest scores, ties to the smaller id (null ids carry ``NO_ID``), in that order."""
    if len(scores) > 4 * k:
        cut = np.partition(scores, len(scores) - k)[len(scores) - k]
        keep = np.flatnonzero(scores >= cut)
    else:
        keep = np.arange(len(scores))
    order = np.lexsort((ids[keep], -scores[keep]))
    return keep[order[:k]]
