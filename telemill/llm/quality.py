"""Quality score by a factorisation machine.

Inputs of a text are its hashed words (damped counts, scaled to length one), statistics of its
structure (shares of symbols, capitals, digits, other scripts and line ends, length of words, share of
distinct words, number of words) and the document's stated number of characters, each statistic in
one of ``BINS`` bins. All pairs of inputs interact through vectors of ``RANK`` numbers; by the
sum-of-squares identity, ``sum_ij <v_i, v_j> x_i x_j = (|sum_i v_i x_i|^2 - sum_i |v_i|^2 x_i^2) / 2``
over pairs, a score takes time linear in the inputs. The machine is fitted by AdaGrad on a bounded
sample (``SAMPLE_ROWS`` labelled documents) in one task.

Nulls and ties: null text counts as empty; an empty text scores by its statistics. A null number of
characters has a bin of its own. A null id is never learned from and counts as held out. Without
labelled rows every score is 0.5. Of several labels of one id the largest counts. Labels, ``lang``,
``source`` and ``doc_id`` are no inputs of a score.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telemill.llm.sampling import labelled_sample
from telemill.llm.text import flat, id_remainder, row_slices, word_hashes

BITS = 16
WORDS = 1 << BITS
BINS = 16
SAMPLE_ROWS = 8_000
EPOCHS = 5
RANK = 4
RATE, DECAY = 0.1, 1e-5
SLICE = 1 << 21
THRESHOLD = 0.7
INPUTS = ("text", "n_chars")

# Classes of bytes: blank, small letter, capital, digit, symbol, part of a longer character, line end.
_CLASSES = np.full(256, 4, np.uint8)
_CLASSES[[32, 9, 11, 12, 13]] = 0
_CLASSES[97:123] = 1
_CLASSES[65:91] = 2
_CLASSES[48:58] = 3
_CLASSES[128:] = 5
_CLASSES[10] = 6
STATISTICS = 9
SIZE = WORDS + STATISTICS * BINS


def _share_bin(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Bins of a share, finer near zero."""
    return np.minimum((np.sqrt(part / np.maximum(whole, 1)) * BINS).astype(np.int64), BINS - 1)


def _size_bin(number: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(1.0 + np.maximum(number, 0)).astype(np.int64), BINS - 1)


def inputs(data: np.ndarray, offsets: np.ndarray, stated: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, position and value of every input of some texts, ordered by row.

    ``stated`` holds the stated numbers of characters, -1 for null.
    """
    n = len(offsets) - 1
    words, owner = word_hashes(data, offsets)
    keys, counts = np.unique(owner << BITS | (words >> np.uint64(64 - BITS)).astype(np.int64), return_counts=True)
    rows = keys >> BITS
    damped = 1 + np.log(counts)
    norm = np.sqrt(np.bincount(rows, damped**2, n))
    n_words = np.bincount(owner, minlength=n)
    distinct = np.bincount(rows, minlength=n)
    byte_rows = np.repeat(np.arange(n), np.diff(offsets))
    kinds = np.bincount(byte_rows * 7 + _CLASSES[data], minlength=7 * n).reshape(n, 7)
    size = np.diff(offsets)
    letters = kinds[:, 1] + kinds[:, 2]
    bins = np.stack(
        [
            _share_bin(kinds[:, 4], size),
            _share_bin(kinds[:, 2], letters),
            _share_bin(kinds[:, 3], size),
            _share_bin(kinds[:, 5], size),
            _share_bin(kinds[:, 6], size),
            np.minimum(np.where(n_words > 0, size / np.maximum(n_words, 1), 0).astype(np.int64), BINS - 1),
            _share_bin(distinct, n_words),
            _size_bin(n_words),
            np.where(stated < 0, BINS - 1, np.minimum(_size_bin(stated), BINS - 2)),
        ],
        axis=1,
    )
    at = WORDS + np.arange(STATISTICS) * BINS + bins
    all_rows = np.r_[rows, np.repeat(np.arange(n), STATISTICS)]
    positions = np.r_[keys & (WORDS - 1), at.ravel()]
    values = np.r_[damped / np.maximum(norm[rows], 1e-12), np.full(n * STATISTICS, 0.5)]
    order = np.argsort(all_rows, kind="stable")
    return all_rows[order], positions[order], values[order]


class Machine:
    """Bias, linear weights and interaction vectors."""

    def __init__(self, bias: float, linear: np.ndarray, vectors: np.ndarray):
        self.bias, self.linear, self.vectors = bias, linear, vectors

    @classmethod
    def fitted(cls, examples: list[tuple[int, np.ndarray, np.ndarray]]) -> "Machine":
        random = np.random.default_rng(1)
        self = cls(0.0, np.zeros(SIZE), random.normal(0, 0.05, (SIZE, RANK)))
        bias_sum, linear_sum, vector_sum = 1e-6, np.full(SIZE, 1e-6), np.full((SIZE, RANK), 1e-6)
        for _ in range(EPOCHS):
            for k in random.permutation(len(examples)):
                label, at, x = examples[k]
                w, v = self.linear[at], self.vectors[at]
                summed = x @ v
                pairs = (summed @ summed - (x**2) @ (v**2).sum(axis=1)) / 2
                gap = 1 / (1 + np.exp(-np.clip(self.bias + w @ x + pairs, -35, 35))) - label
                for_w = gap * x + DECAY * w
                for_v = gap * (x[:, None] * summed - v * (x**2)[:, None]) + DECAY * v
                bias_sum += gap**2
                linear_sum[at] += for_w**2
                vector_sum[at] += for_v**2
                self.bias -= RATE * gap / np.sqrt(bias_sum)
                self.linear[at] = w - RATE * for_w / np.sqrt(linear_sum[at])
                self.vectors[at] = v - RATE * for_v / np.sqrt(vector_sum[at])
        return self

    def scores(self, rows: np.ndarray, at: np.ndarray, x: np.ndarray, n: int) -> np.ndarray:
        total = self.bias + np.bincount(rows, self.linear[at] * x, n)
        for k in range(RANK):
            term = self.vectors[at, k] * x
            total += (np.bincount(rows, term, n) ** 2 - np.bincount(rows, term**2, n)) / 2
        return 1 / (1 + np.exp(-np.clip(total, -500, 500)))


def _sliced(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    data, offsets = flat(batch.column("text"))
    stated = batch.column("n_chars").fill_null(-1).to_numpy()
    for start, end in row_slices(offsets, SLICE):
        part = data[offsets[start] : offsets[end]]
        yield start, end, *inputs(part, offsets[start : end + 1] - offsets[start], stated[start:end])


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    examples = []
    for batch in batches:
        labels = batch.column("label").to_numpy()
        for start, end, rows, at, x in _sliced(batch):
            borders = np.searchsorted(rows, np.arange(end - start + 1))
            examples += [
                (int(labels[start + k]), at[borders[k] : borders[k + 1]], x[borders[k] : borders[k + 1]])
                for k in range(end - start)
            ]
    if examples:
        machine = Machine.fitted(examples)
        arrays = (np.array([machine.bias]), machine.linear, machine.vectors.ravel())
        yield pa.RecordBatch.from_arrays(
            [pa.array([a.astype("<f4").tobytes()], pa.binary()) for a in arrays], names=["bias", "linear", "vectors"]
        )


def fit(documents: DataFrame, labels: DataFrame, learnable, label: str = "quality", rows: int = SAMPLE_ROWS) -> Machine:
    sample = labelled_sample(documents, labels, label, learnable, rows, 1, INPUTS)
    found = sample.mapInArrow(_train, "bias binary, linear binary, vectors binary").first()
    if found is None:
        return Machine(0.0, np.zeros(SIZE), np.zeros((SIZE, RANK)))
    bias, linear, vectors = (np.frombuffer(found[c], "<f4").astype(float) for c in ("bias", "linear", "vectors"))
    return Machine(float(bias[0]), linear, vectors.reshape(SIZE, RANK))


def quality(documents: DataFrame, labels: DataFrame, folds: int = 4, held: int = 2) -> DataFrame:
    """``doc_id, held_out, score, predicted``."""
    fold = id_remainder(F.col("doc_id"), folds)
    texts = documents.withColumn("n_chars", F.col("n_chars").cast("bigint"))
    machine = fit(texts, labels, fold != held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = np.zeros(batch.num_rows)
            for start, end, rows, at, x in _sliced(batch):
                scores[start:end] = machine.scores(rows, at, x, end - start)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores)], names=["doc_id", "score"])

    rows = texts.select("doc_id", *INPUTS)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, score double").select(
        "doc_id",
        F.coalesce(fold == held, F.lit(True)).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
