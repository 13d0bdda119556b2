"""Language identification by cross-parsing entropy.

For each language a suffix automaton of labelled text is built. A document is cut into the longest
phrases that occur in that text; the fewer phrases it takes, the closer the languages. With ``c``
phrases over ``n`` characters, ``c * log2(m) / n`` estimates the bits a character takes given the
language, where ``m`` is the size of the largest training text: every language prices a phrase alike,
so the language with the fewest phrases wins, and a tiny training text (one short labelled document)
cannot win by a cheap price for its many short phrases.

Text is normalised first: letters in lower case, every run of other characters one separator. Long
documents are parsed in segments of ``SEGMENT`` characters, each from the automaton's start, so that
thousands of segments step through the automaton together in numpy; every character of every
document is parsed, and a segment border adds at most one phrase per language.

The automata are fitted on a bounded sample: ``PER_LANGUAGE`` documents a language, chosen by a hash
of the id, ``SAMPLE_CHARS`` characters from the middle of each, ``TRAINING_CHARS`` characters in all
(fewer if there are so many languages that the tables would exceed ``TABLE_BYTES``).

Nulls and ties: text that is null or has no letter is ``und`` with score 0; equal estimates go to the
first language by code point; a null id is never learned from and counts as held out. Without any
labelled text everything is ``und``. Repeated rows are predicted one by one. ``lang``, ``source`` and
``doc_id`` are no inputs of a prediction.
"""

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from telemill.llm.text import flat, id_remainder, row_slices

PER_LANGUAGE = 64
SAMPLE_CHARS = 512
TRAINING_CHARS = 24_000
TABLE_BYTES = 1 << 26
SEGMENT = 1024
SLICE = 1 << 21
SEPARATOR, UNSEEN = 0, 1
UNKNOWN = "und"


def training_text(documents: DataFrame, learnable) -> dict[str, str]:
    """The bounded sample: for each language some text, in an order fixed by a hash of the id."""
    middle = F.greatest(F.lit(1), ((F.length("text") - SAMPLE_CHARS) / 2).cast("int"))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text"))
    rows = (
        documents.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & learnable)
        .select("doc_id", F.col("lang").cast("string").alias("lang"), "text")
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= PER_LANGUAGE)
        .select("lang", "rank", F.col("text").substr(middle, F.lit(SAMPLE_CHARS)).alias("part"))
        .collect()
    )
    parts: dict[str, list] = {}
    for row in sorted(rows, key=lambda r: (r.lang, r.rank)):
        parts.setdefault(row.lang, []).append(row.part)
    return {lang: " ".join(texts) for lang, texts in parts.items()}


def suffix_automaton(codes: list[int]) -> list[dict[int, int]]:
    """Transitions of the automaton of all substrings of ``codes``; state 0 is the start."""
    moves: list[dict[int, int]] = [{}]
    longest, link = [0], [-1]
    last = 0
    for code in codes:
        state = len(moves)
        moves.append({})
        longest.append(longest[last] + 1)
        link.append(0)
        at = last
        while at >= 0 and code not in moves[at]:
            moves[at][code] = state
            at = link[at]
        if at >= 0:
            target = moves[at][code]
            if longest[at] + 1 == longest[target]:
                link[state] = target
            else:
                twin = len(moves)
                moves.append(dict(moves[target]))
                longest.append(longest[at] + 1)
                link.append(link[target])
                while at >= 0 and moves[at].get(code) == target:
                    moves[at][code] = twin
                    at = link[at]
                link[target] = link[state] = twin
        last = state
    return moves


class Parser:
    """Automata of all languages in one table: what a character does in a state.

    The upper bits of an entry count the phrases the step ends, the lower ones are the next state.
    """

    def __init__(self, texts: dict[str, str]):
        self.languages = sorted(texts)
        seen = sorted({c for text in texts.values() for c in text.lower() if len(c) == 1 and _is_word(c)})
        self.width = len(seen) + 3
        self.padding = self.width - 1
        self.classes = _classes(seen)
        per_state = self.width * 4
        limit = min(TRAINING_CHARS, TABLE_BYTES // (2 * per_state * max(1, len(texts))))
        tables, self.starts, self.bits, base = [], [], [], 0
        for language in self.languages:
            codes = _normal(self.classes[_points(texts[language])])
            codes = codes[codes != UNSEEN][:limit]
            moves = suffix_automaton(codes.tolist())
            table = np.zeros((len(moves), self.width), np.int32)
            # A missing move ends the phrase and starts the next one with this character.
            table[:] = 1 << 28
            table[:, list(moves[0])] |= np.array(list(moves[0].values()), np.int32) + base
            table[:, [c for c in range(self.width) if c not in moves[0]]] = (2 << 28) + base
            table[0, [c for c in range(self.width) if c not in moves[0]]] = (1 << 28) + base
            for state, known in enumerate(moves):
                if known:
                    table[state, list(known)] = np.array(list(known.values()), np.int32) + base
            table[:, self.padding] = np.arange(base, base + len(moves))
            tables.append(table)
            self.starts.append(base)
            self.bits.append(len(codes))
            base += len(moves)
        # One price a phrase for all languages: that of the largest training text.
        self.bits = [float(np.log2(max(self.bits, default=0) + 2))] * len(self.bits)
        self.table = np.concatenate(tables).ravel() if tables else np.zeros(0, np.int32)

    def phrases(self, codes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Phrases of each row (``lengths`` codes each, one after another) in each language."""
        rows = len(lengths)
        pieces = -(-lengths // SEGMENT)
        owner = np.repeat(np.arange(rows), pieces)
        first = np.cumsum(pieces) - pieces
        border = np.cumsum(lengths) - lengths
        nth = np.arange(len(owner)) - first[owner]
        begin = border[owner] + nth * SEGMENT
        size = np.minimum(SEGMENT, lengths[owner] - nth * SEGMENT)
        counts = np.zeros((rows, len(self.languages)), np.int64)
        if not len(owner):
            return counts
        order = np.argsort(-size, kind="stable")
        owner, begin, size = owner[order], begin[order], size[order]
        ends = np.r_[codes, np.zeros(1, codes.dtype)]
        active = np.searchsorted(-size, -np.arange(1, size[0] + 1), side="right")
        for k, start in enumerate(self.starts):
            state = np.full(len(size), start, np.int64)
            found = np.zeros(len(size), np.int64)
            for step in range(size[0]):
                n = active[step]
                value = self.table[state[:n] * self.width + ends[begin[:n] + step]]
                found[:n] += value >> 28
                state[:n] = value & 0xFFFFFFF
            found += state != start
            counts[:, k] = np.bincount(owner, found, rows).astype(np.int64)
        return counts


def _is_word(char: str) -> bool:
    return unicodedata.category(char)[0] in "LM"


_kinds: list[np.ndarray] = []


def _letter_kinds() -> np.ndarray:
    """For each code point: 0 no part of a word, 1 a mark, 2 a letter."""
    if not _kinds:
        kinds = {"L": 2, "M": 1}
        _kinds.append(
            np.fromiter((kinds.get(unicodedata.category(chr(c))[0], 0) for c in range(0x110000)), np.uint8)
        )
    return _kinds[0]


def _classes(seen: list[str]) -> np.ndarray:
    classes = np.where(_letter_kinds() > 0, UNSEEN, SEPARATOR).astype(np.int16)
    for k, char in enumerate(seen):
        for form in {char, char.upper(), char.title()}:
            if len(form) == 1:
                classes[ord(form)] = k + 2
    return classes


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _normal(classes: np.ndarray) -> np.ndarray:
    keep = classes != SEPARATOR
    keep[1:] |= classes[:-1] != SEPARATOR
    return classes[keep]


_parsers: dict[tuple, Parser] = {}


def _parser(texts: dict[str, str]) -> Parser:
    key = tuple(sorted(texts.items()))
    if key not in _parsers:
        _parsers.clear()
        _parsers[key] = Parser(texts)
    return _parsers[key]


def judge(parser: Parser, column: pa.Array) -> tuple[list[str], np.ndarray]:
    """The language and the score of each text."""
    data, offsets = flat(column)
    best = np.full(len(column), -1)
    scores = np.zeros(len(column))
    for start, end in row_slices(offsets, SLICE):
        if not parser.languages:
            break
        part = data[offsets[start] : offsets[end]]
        points = _points(part.tobytes().decode("utf-8", "replace"))
        # Row borders in characters: bytes that start one.
        starts = np.r_[0, np.cumsum((part & 0xC0) != 0x80)]
        borders = starts[offsets[start : end + 1] - offsets[start]]
        classes = parser.classes[points]
        keep = classes != SEPARATOR
        keep[1:] |= classes[:-1] != SEPARATOR
        heads = borders[:-1][borders[:-1] < len(keep)]
        keep[heads] = classes[heads] != SEPARATOR
        kept = np.r_[0, np.cumsum(keep)][borders]
        letters = np.r_[0, np.cumsum(_letter_kinds()[points] == 2)][borders]
        lengths = np.diff(kept)
        counts = parser.phrases(classes[keep], lengths)
        bits = counts * np.array(parser.bits) / np.maximum(lengths, 1)[:, None]
        choice = bits.argmin(axis=1)
        least = bits.min(axis=1, keepdims=True)
        weight = np.exp2((least - bits) * np.minimum(lengths, 64)[:, None])
        known = np.diff(letters) > 0
        best[start:end] = np.where(known, choice, -1)
        scores[start:end] = np.where(known, 1 / weight.sum(axis=1), 0.0)
    return [parser.languages[k] if k >= 0 else UNKNOWN for k in best], scores


def predict(documents: DataFrame, texts: dict[str, str]) -> DataFrame:
    """``documents`` (no column names ``lang_pred`` or ``score``) with these two columns added."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = _parser(texts)
        for batch in batches:
            languages, scores = judge(parser, batch.column("text"))
            arrays = [*batch.columns, pa.array(languages, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names, "lang_pred", "score"])

    schema = T.StructType(list(documents.schema)).add("lang_pred", "string").add("score", "double")
    return documents.mapInArrow(run, schema)


def identify(documents: DataFrame, folds: int = 5, held: int = 0) -> DataFrame:
    """``doc_id, held_out, lang_pred, score``: learned from all folds but ``held``."""
    fold = id_remainder(F.col("doc_id"), folds)
    texts = training_text(documents, fold != held)
    return predict(documents.select("doc_id", "text"), texts).select(
        "doc_id", F.coalesce(fold == held, F.lit(True)).alias("held_out"), "lang_pred", "score"
    )
