"""Text as Spark expressions and as flat numpy arrays.

The numpy side works on the bytes of an Arrow string column: no Python string is made for a word.
Words are ``[^\\x20\\x09-\\x0D]+``; these separators are single bytes in UTF-8.
"""

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = " \t\n\x0b\x0c\r"


def lower_ascii(text: Column) -> Column:
    """A-Z only; every other character stays. Text of one byte a character takes the faster way."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    )


def id_remainder(doc_id: Column, divisor: int) -> Column:
    """crc32 of the id as text, modulo ``divisor``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % divisor


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
#: Everything but letters and the bytes of longer characters separates words.
NO_LETTER = np.ones(256, dtype=bool)
NO_LETTER[65:91] = NO_LETTER[97:123] = NO_LETTER[128:] = False
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
BLOCK = 1 << 20
_powers: list[np.ndarray] = []


def mix(values: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (a finaliser of xor-shifts and odd multipliers)."""
    values = values ^ (values >> np.uint64(30))
    values = values * np.uint64(0xBF58476D1CE4E5B9)
    values = values ^ (values >> np.uint64(27))
    values = values * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def _power_tables(size: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < size:
        _powers[:] = [
            np.cumprod(np.r_[np.uint64(1), np.full(size - 1, base, dtype=np.uint64)])
            for base in (_BASE, _BASE_INVERSE)
        ]
    return _powers[0], _powers[1]


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the ``len + 1`` borders of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, borders, data = column.buffers()
    if len(column) == 0 or borders is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(borders, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def _cuts(data: np.ndarray, offsets: np.ndarray, blank: np.ndarray) -> Iterator[tuple[int, int]]:
    """Byte ranges of about ``BLOCK`` that cut no word: they end at a blank or at a row's border."""
    start, total = 0, len(data)
    while start < total:
        end = min(start + BLOCK, total)
        if end < total:
            border = int(offsets[np.searchsorted(offsets, end)])
            while end < border:
                found = np.flatnonzero(blank[data[end : min(end + 4096, border)]])
                if len(found):
                    end += int(found[0])
                    break
                end = min(end + 4096, border)
        yield start, end
        start = end


def word_hashes(
    data: np.ndarray, offsets: np.ndarray, blank: np.ndarray = _BLANK, stem: int = 0
) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words (A-Z lower-cased) in order, and the row each belongs to.

    A word's hash is a polynomial in an odd base, read off one running sum per block, then mixed.
    ``blank`` tells which bytes separate words; with ``stem`` only that many first bytes count.
    """
    hashes, rows = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for start, end in _cuts(data, offsets, blank):
        block = data[start:end]
        power, inverse = _power_tables(max(BLOCK, len(block)))
        inside = ~blank[block]
        first = np.zeros(len(block) + 1, bool)
        borders = offsets[(offsets >= start) & (offsets < end)] - start
        first[borders] = True
        first[0] = first[-1] = True
        begins = inside & (first[:-1] | ~np.r_[False, inside[:-1]])
        ends = inside & (first[1:] | ~np.r_[inside[1:], False])
        begin, last = np.flatnonzero(begins), np.flatnonzero(ends)
        if stem:
            last = np.minimum(last, begin + stem - 1)
        sums = np.cumsum(_LOWER[block].astype(np.uint64) * power[: len(block)], dtype=np.uint64)
        before = np.where(begin > 0, sums[begin - 1], np.uint64(0))
        value = (sums[last] - before) * inverse[begin]
        hashes.append(mix(value + (last - begin + 1).astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)))
        rows.append(np.searchsorted(offsets, begin + start, side="right") - 1)
    return np.concatenate(hashes), np.concatenate(rows)


def row_slices(offsets: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``size`` bytes, one row at least."""
    start, rows = 0, len(offsets) - 1
    while start < rows:
        end = int(np.searchsorted(offsets, offsets[start] + size, side="right")) - 1
        end = min(max(end, start + 1), rows)
        yield start, end
        start = end
