"""Toxicity score by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the distinct words (letters only, A-Z lower-cased), their first ``STEM`` bytes, pairs of
neighbours, and pairs with one word between them of a text, hashed to ``BUCKETS``. Learning is online with a rate per coordinate and an L1 penalty that leaves
most weights at exactly zero, so the model is a short list of buckets and weights. It is fitted on a
bounded sample (``SAMPLE_ROWS`` labelled documents), ``EPOCHS`` times over. With ``PARTS`` above one,
parts of the sample are learned at once and their weights averaged, which costs recall.

Nulls and ties: a text that is null or has no word scores by the bias alone. A null id is never
learned from and counts as held out. Without labelled rows every score is 0.5. Repeated rows get
equal scores; of several labels of one id the largest counts. Labels, ``lang``, ``source`` and
``doc_id`` are no inputs of a score.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telemill.llm.sampling import labelled_sample
from telemill.llm.text import NO_LETTER, flat, id_remainder, mix, row_slices, word_hashes

BITS = 20
BUCKETS = 1 << BITS
SAMPLE_ROWS = 16_000
PARTS = 1
EPOCHS = 4
SLICE = 1 << 22
RATE, SMOOTH, L1, L2 = 2.0, 1.0, 4.0, 0.0
STEM = 6
THRESHOLD = 0.7
BIAS = -1


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words, their stems, pairs and skip pairs, and the row of each (with repeats)."""
    words, rows = word_hashes(data, offsets, NO_LETTER)
    stems, _ = word_hashes(data, offsets, NO_LETTER, STEM)
    found, owner = [words, mix(stems)], [rows, rows]
    for apart, salt in ((1, 0xA24BAED4963EE407), (2, 0x9FB21C651E98DF25)):
        if len(words) > apart:
            same = rows[apart:] == rows[:-apart]
            pair = words[:-apart] * np.uint64(salt) + words[apart:]
            found.append(mix(pair[same]))
            owner.append(rows[apart:][same])
    shift = np.uint64(64 - BITS)
    return (np.concatenate(found) >> shift).astype(np.int64), np.concatenate(owner)


class Ftrl:
    """The learner: sums of adjusted gradients ``z`` and of squared gradients ``n`` per bucket."""

    def __init__(self):
        self.z = np.zeros(BUCKETS)
        self.n = np.zeros(BUCKETS)
        self.bias_z = self.bias_n = 0.0

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        shrunk = np.sign(z) * np.maximum(np.abs(z) - L1, 0.0)
        return -shrunk / ((SMOOTH + np.sqrt(n)) / RATE + L2)

    def bias(self) -> float:
        return -self.bias_z / ((SMOOTH + np.sqrt(self.bias_n)) / RATE)

    def learn(self, at: np.ndarray, label: int) -> None:
        weights, bias = self.weights(at), self.bias()
        gradient = 1 / (1 + np.exp(-np.clip(bias + weights.sum(), -35, 35))) - label
        n = self.n[at]
        grown = n + gradient**2
        self.z[at] += gradient - (np.sqrt(grown) - np.sqrt(n)) / RATE * weights
        self.n[at] = grown
        grown = self.bias_n + gradient**2
        self.bias_z += gradient - (np.sqrt(grown) - np.sqrt(self.bias_n)) / RATE * bias
        self.bias_n = grown


def _examples(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray]]:
    """Part, label and distinct buckets of each row."""
    data, offsets = flat(batch.column("text"))
    parts, labels = batch.column("part").to_numpy(), batch.column("label").to_numpy()
    for start, end in row_slices(offsets, SLICE):
        at, owner = features(data[offsets[start] : offsets[end]], offsets[start : end + 1] - offsets[start])
        order = np.argsort(owner, kind="stable")
        borders = np.searchsorted(owner[order], np.arange(end - start + 1))
        for k in range(end - start):
            yield int(parts[start + k]), int(labels[start + k]), np.unique(at[order[borders[k] : borders[k + 1]]])


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, list] = {}
    for batch in batches:
        for part, label, at in _examples(batch):
            held.setdefault(part, []).append((label, at.astype(np.int32)))
    for rows in held.values():
        learner = Ftrl()
        for _ in range(EPOCHS):
            for label, at in rows:
                learner.learn(at, label)
        weights = learner.weights(slice(None))
        some = np.flatnonzero(weights)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.r_[BIAS, some]), pa.array(np.r_[learner.bias(), weights[some]])], names=["bucket", "weight"]
        )


def fit(documents: DataFrame, labels: DataFrame, learnable, label: str = "toxic", rows: int = SAMPLE_ROWS):
    """Buckets and weights other than zero, and the bias."""
    sample = labelled_sample(documents, labels, label, learnable, rows, PARTS)
    parts = sample.mapInArrow(_train, "bucket bigint, weight double")
    model = parts.groupBy("bucket").agg(F.sum("weight").alias("weight")).collect()
    teachers = sum(1 for r in model if r.bucket == BIAS) and PARTS
    weights = sorted((r.bucket, r.weight / teachers) for r in model)
    bias = weights[0][1] if weights else 0.0
    return np.array([b for b, _ in weights[1:]], np.int64), np.array([w for _, w in weights[1:]]), bias


def score(column: pa.Array, weights: np.ndarray, bias: float) -> np.ndarray:
    """Scores of texts; ``weights`` has one entry per bucket."""
    data, offsets = flat(column)
    sums = np.full(len(column), bias)
    for start, end in row_slices(offsets, SLICE):
        at, owner = features(data[offsets[start] : offsets[end]], offsets[start : end + 1] - offsets[start])
        weighty = weights[at] != 0
        once = np.unique(owner[weighty] << BITS | at[weighty])
        sums[start:end] += np.bincount(once >> BITS, weights[once & (BUCKETS - 1)], end - start)
    return 1 / (1 + np.exp(-np.clip(sums, -500, 500)))


def toxicity(documents: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1) -> DataFrame:
    """``doc_id, held_out, score, predicted``."""
    fold = id_remainder(F.col("doc_id"), folds)
    buckets, values, bias = fit(documents, labels, fold != held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = np.zeros(BUCKETS)
        weights[buckets] = values
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(score(batch.column("text"), weights, bias))],
                names=["doc_id", "score"],
            )

    rows = documents.select("doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, score double").select(
        "doc_id",
        F.coalesce(fold == held, F.lit(True)).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
