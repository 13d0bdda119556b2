"""Rows of one key, gathered from batches that come sorted by it."""

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """One table for each run of equal ``keys`` (integers); a run may go over several batches."""
    waiting: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        values = np.stack([batch.column(k).to_numpy().astype(np.int64) for k in keys], axis=1)
        borders = np.r_[0, np.flatnonzero((np.diff(values, axis=0) != 0).any(axis=1)) + 1, len(values)]
        for start, end in zip(borders[:-1].tolist(), borders[1:].tolist(), strict=True):
            key = tuple(values[start].tolist())
            if waiting and key != last:
                yield pa.Table.from_batches(waiting)
                waiting = []
            waiting.append(batch.slice(start, end - start))
            last = key
    if waiting:
        yield pa.Table.from_batches(waiting)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int) -> Iterator[pa.Table]:
    """Tables of whole runs of equal ``keys``, of about ``rows`` rows and a batch, or one larger run."""
    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        waiting.append(batch)
        if sum(b.num_rows for b in waiting) < rows:
            continue
        held = pa.Table.from_batches(waiting)
        borders = np.flatnonzero(reduce(np.logical_or, [np.diff(held.column(k).to_numpy()) != 0 for k in keys]))
        if len(borders):
            end = int(borders[-1]) + 1
            yield held.slice(0, end)
            waiting = held.slice(end).to_batches()
    if waiting:
        yield pa.Table.from_batches(waiting)
