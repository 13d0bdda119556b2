"""Hard-negative mining by a secondary-sort shuffle.

Every anchor is scored against all rows in units of (anchor batch, candidate shard), see ``dense``. What a
unit leaves is bounded before the shuffle: in a first pass, the five best rows of the anchor's label
(the anchor's positives are among these); in a second, with the positives' scores known, again those rows
and, for each positive, the five best rows of another label inside its score window. These pair scores,
keyed (anchor, descending score, id), are dealt by anchor and sorted within partitions, Spark's form of
``repartitionAndSortWithinPartitions``. A streaming iterator then walks each anchor's rows in order: a
row of the anchor's label opens a positive window while fewer than ``positives`` are open; a row of another
label joins every open window whose range holds it, until the window has ``negatives`` rows. No anchor's
rows are held at once: the iterator keeps the open windows and the rows of the current score only.

Semantics: rows with a null label, a null vector or a null or non-finite component take no part. Labels
of ids divisible by ``shift_every`` first become ``(label + 1) % classes``. Anchors are the distinct
(vec_id, label, vector) rows with ``vec_id % anchor_every == 0``; a row is "other" if its id differs from the
anchor's (null ids differ from all and sort after every id). Rows are ordered by score, higher first, ties
by the smaller id. A negative of positive p has ``low * p <= 100 * n <= 100 * p`` in percent; a positive
with a negative score has none. Positives without negatives leave no row. Empty table: no rows.
"""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from telemill.llm import dense

PAIRS = "anchor_id long, anchor_tag long, same boolean, vec_id long, score long"
MINED = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def _scored(row):
    """Anchors and candidates of a unit with all their scores (candidates that are the anchor removed)."""
    a, c = dense.unpack(row, "q"), dense.unpack(row, "c")
    scores = dense.inner(a["comps"], c["comps"])
    for i in range(a["n"]):
        other = ~(c["has_id"] & (c["ids"] == a["ids"][i])) if a["has_id"][i] else np.ones(c["n"], np.bool_)
        same = other & (c["labels"] == a["labels"][i])
        yield a, c, i, scores[i], same, other & ~same


def _positives_unit(row, positives: int):
    out = []
    for a, c, i, scores, same, _ in _scored(row):
        at = np.flatnonzero(same)
        for j in at[dense.first(scores[at], c["ids"][at], positives)]:
            out.append((int(a["ids"][i]), int(a["tags"][i]), True, int(c["ids"][j]) if c["has_id"][j] else None, int(scores[j])))
    return out


def _pairs_unit(row, positives: int, negatives: int, low: int):
    out = []
    for a, c, i, scores, same, different in _scored(row):
        anchor, tag = int(a["ids"][i]), int(a["tags"][i])
        chosen = set()
        at = np.flatnonzero(same)
        chosen |= {(True, int(j)) for j in at[dense.first(scores[at], c["ids"][at], positives)]}
        for p in a["extra"][i]:
            if p == dense.NO_LABEL or p < 0:
                continue
            inside = different & (100 * scores <= 100 * p) & (100 * scores >= low * p)
            at = np.flatnonzero(inside)
            chosen |= {(False, int(j)) for j in at[dense.first(scores[at], c["ids"][at], negatives)]}
        out += [(anchor, tag, s, int(c["ids"][j]) if c["has_id"][j] else None, int(scores[j])) for s, j in chosen]
    return out


def _walk(positives: int, negatives: int, low: int):
    """The streaming iterator over pair rows sorted by (anchor, tag, score descending, id)."""

    def finish(windows):
        for p_id, p_score, found in windows:
            for rank, (n_id, n_score) in enumerate(found, 1):
                yield (None, p_id, rank, n_id, p_score, n_score)

    def run(frames):
        key, windows, tie_score, ties = None, [], None, []
        for frame in frames:
            out = []
            for anchor, tag, same, vec_id, score in frame.itertuples(index=False, name=None):
                vec_id = None if pd.isna(vec_id) else int(vec_id)
                if (anchor, tag) != key:
                    if key is not None:
                        out += [(key[0], *r[1:]) for r in finish(windows)]
                    key, windows, tie_score, ties = (anchor, tag), [], None, []
                if score != tie_score:
                    tie_score, ties = score, []
                if same:
                    if len(windows) < positives:
                        found = [t for t in ties if low * score <= 100 * t[1] <= 100 * score][:negatives]
                        windows.append((vec_id, score, found))
                    continue
                for p_id, p_score, found in windows:
                    if len(found) < negatives and low * p_score <= 100 * score <= 100 * p_score:
                        found.append((vec_id, score))
                if len(ties) < negatives:
                    ties.append((vec_id, score))
            yield pd.DataFrame(out, columns=MINED_COLUMNS)
        if key is not None:
            yield pd.DataFrame([(key[0], *r[1:]) for r in finish(windows)], columns=MINED_COLUMNS)

    return run


MINED_COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def mine(
    embeddings: DataFrame,
    anchor_every: int = 100,
    shift_every: int = 7,
    classes: int = 10,
    positives: int = 5,
    negatives: int = 5,
    low: int = 80,
    scale: int = 256,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for every anchor."""
    vectors = dense.integer_vectors(embeddings, scale).where(F.col("label").isNotNull())
    label = F.when(F.col("vec_id") % shift_every == 0, (F.col("label") + 1) % classes).otherwise(F.col("label"))
    vectors = vectors.withColumn("label", label.cast("int"))
    anchors = vectors.where(F.col("vec_id") % anchor_every == 0).dropDuplicates(["vec_id", "label", "comps"])
    shards, n_shards = dense.packed(vectors, dense.SHARD_ROWS, "negatives-shards")

    def unit_rows(make):
        def run(frames):
            for frame in frames:
                yield pd.DataFrame([r for _, row in frame.iterrows() for r in make(row)], columns=PAIRS.replace(",", "").split()[::2])

        return run

    first_batches, _ = dense.packed(anchors, dense.BATCH_QUERIES, "negatives-anchors")
    tops = dense.units(first_batches, shards, n_shards).mapInPandas(unit_rows(lambda r: _positives_unit(r, positives)), PAIRS)
    order = Window.partitionBy("anchor_id", "anchor_tag").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    best = tops.withColumn("k", F.row_number().over(order)).where(F.col("k") <= positives)
    scores = best.groupBy("anchor_id", "anchor_tag").agg(F.array_sort(F.collect_list("score")).alias("scores"))
    tagged = anchors.withColumn("anchor_tag", F.xxhash64("label", "comps"))
    filled = F.coalesce(F.col("scores"), F.array().cast("array<long>"))
    padded = F.concat(filled, F.array_repeat(F.lit(int(dense.NO_LABEL)), positives - F.size(filled)))
    with_scores = tagged.join(scores, (tagged.vec_id == scores.anchor_id) & (tagged.anchor_tag == scores.anchor_tag), "left")
    with_scores = with_scores.select("vec_id", "label", "comps", padded.alias("windows"))
    batches, _ = dense.packed(with_scores, dense.BATCH_QUERIES, "negatives-windows", extra="windows")
    pairs = dense.units(batches, shards, n_shards).mapInPandas(unit_rows(lambda r: _pairs_unit(r, positives, negatives, low)), PAIRS)
    sorted_pairs = pairs.repartition("anchor_id", "anchor_tag").sortWithinPartitions(
        "anchor_id", "anchor_tag", F.desc("score"), F.asc_nulls_last("vec_id")
    )
    return sorted_pairs.mapInPandas(_walk(positives, negatives, low), MINED)
