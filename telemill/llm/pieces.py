"""Subword encoding and decoding with a BPE piece model, through a table of last tokens.

For every prefix of a word there is exactly one token that a BPE encoding of the prefix can end with.
The table is filled from left to right: an automaton over all pieces reports those that end at a
position, and the one that may follow the last token of the prefix before it is stored. The ids are
then read backwards from the end. Two tokens may stand side by side if no merge would have joined
across their border before both were complete; this is decided on the tokens' merge histories.

No piece holds a blank behind another character, so a text falls into words (blanks, then other
characters) whose encodings are independent; a task keeps the encodings of recent words.

Nulls and ties: null text counts as empty, which encodes to the end id alone and decodes to the empty
text. Characters without a piece become their UTF-8 bytes. Merges of equal score are applied from
the left, which concerns runs of blanks only. Repeated rows are encoded one by one; very long texts
need memory for their own words only. Other columns are ignored.
"""

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor

BLANK = "▁"
NO_PIECE = -1
CACHED_WORDS = 200_000
ROWS_AT_ONCE = 256


class PieceTable:
    """The model's pieces: automaton, merge histories, and the words encoded lately."""

    def __init__(self, path: str):
        model = SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.end_id = model.eos_id()
        self.bytes_of: list[bytes] = []
        self.byte_ids = [0] * 256
        self.ids: dict[str, int] = {}
        self.score: list[float] = []
        for i in range(size):
            piece = model.id_to_piece(i)
            self.score.append(model.get_score(i))
            if model.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.bytes_of.append(bytes([int(piece[3:5], 16)]))
            elif model.is_control(i) or model.is_unknown(i):
                self.bytes_of.append(b"")
            else:
                self.ids[piece] = i
                self.bytes_of.append(piece.replace(BLANK, " ").encode())
        self.text_of = {i: piece for piece, i in self.ids.items()}
        self.halves: dict[int, tuple[int, int]] = {}
        self.joined: dict[tuple[int, int], int] = {}
        self.reachable: set[int] = set()
        for piece, i in self.ids.items():
            merged = self.merge(piece)
            if len(merged) == 1:
                self.reachable.add(i)
        for i in self.reachable:
            if len(self.text_of[i]) > 1:
                left, right = self._last_halves(i)
                self.halves[i] = (left, right)
                self.joined[(left, right)] = i
        self.automaton = ahocorasick.Automaton()
        for i in self.reachable:
            self.automaton.add_word(self.text_of[i], (i, len(self.text_of[i])))
        self.automaton.make_automaton()
        self.length_of = {i: len(self.text_of[i]) for i in self.reachable}
        self.chars = {p for p in self.ids if len(p) == 1}
        self.decimal = [b"%d" % i for i in range(size)]
        self.right_edges = {i: self._edge(i, 1) for i in self.reachable}
        self.left_edges = {i: self._edge(i, 0) for i in self.reachable}
        self.beside: dict[int, bool] = {}
        self.words: dict[str, tuple[int, bytes, bytes]] = {}
        self.older_words: dict[str, tuple[int, bytes, bytes]] = {}

    def merge(self, text: str, keep_last: bool = False) -> list[str]:
        """Plain merging of a short text: best score first, leftmost of equals."""
        symbols = list(text)
        before = symbols
        while len(symbols) > 1:
            best, at = None, -1
            for k in range(len(symbols) - 1):
                i = self.ids.get(symbols[k] + symbols[k + 1])
                if i is not None and (best is None or self.score[i] > best):
                    best, at = self.score[i], k
            if at < 0:
                break
            before = symbols
            symbols = [*symbols[:at], symbols[at] + symbols[at + 1], *symbols[at + 2 :]]
        return before if keep_last else symbols

    def _last_halves(self, i: int) -> tuple[int, int]:
        left, right = self.merge(self.text_of[i], keep_last=True)
        return self.ids.get(left, NO_PIECE), self.ids.get(right, NO_PIECE)

    def _edge(self, i: int, side: int) -> list[tuple[int, float]]:
        """The symbols that stand at one edge of a token while it is built, outermost first, each with
        the score of the merge that ends it."""
        edge, until = [], float("-inf")
        while True:
            edge.append((i, until))
            if i not in self.halves:
                return edge
            until = self.score[i]
            i = self.halves[i][side]

    def may_follow(self, left: int, right: int) -> bool:
        """Whether an encoding can hold ``left`` and ``right`` side by side."""
        key = left << 20 | right
        known = self.beside.get(key)
        if known is None:
            if len(self.beside) > 2_000_000:
                self.beside.clear()
            known = self.beside[key] = self._compatible(left, right)
        return known

    def _compatible(self, left: int, right: int) -> bool:
        joined, score = self.joined, self.score
        if self.bytes_of[left].strip(b" ") == b"" or self.bytes_of[right].strip(b" ") == b"":
            # Runs of blanks merge at one score: settled by merging the two tokens' text.
            return self.merge(self.text_of[left] + self.text_of[right]) == [self.text_of[left], self.text_of[right]]
        for x, x_until in self.right_edges[left]:
            for y, y_until in self.left_edges[right]:
                across = joined.get((x, y))
                # A merge across comes first if its score beats what ends the symbols on both sides;
                # of equal scores the left one is first.
                if across is not None and score[across] > x_until and score[across] >= y_until:
                    return False
        return True

    def encode_word(self, word: str) -> list[int]:
        """Ids of one word (blanks written as ``BLANK``)."""
        size = len(word)
        last: list[int | None] = [None] * (size + 1)
        last[0] = NO_PIECE
        beside, may_follow = self.beside, self.may_follow
        if not self.chars.issuperset(word):
            # A character without a piece is a token of its own, and nothing merges across it.
            for end, char in enumerate(word):
                if char not in self.chars:
                    last[end + 1] = NO_PIECE
        for end, (i, length) in self.automaton.iter(word):
            if last[end + 1] is None:
                before = last[end + 1 - length]
                if before is not None:
                    if before == NO_PIECE:
                        last[end + 1] = i
                    else:
                        fits = beside.get(before << 20 | i)
                        if may_follow(before, i) if fits is None else fits:
                            last[end + 1] = i
        found, at, length_of = [], size, self.length_of
        while at > 0:
            i = last[at]
            if i == NO_PIECE:
                at -= 1
                found.extend(self.byte_ids[b] for b in reversed(word[at].encode("utf-8", "replace")))
            else:
                at -= length_of[i]
                found.append(i)
        found.reverse()
        return found

    def word(self, word: str) -> tuple[int, bytes, bytes]:
        """Number of ids, the ids in decimal, and the text they decode to."""
        entry = self.older_words.get(word)
        if entry is None:
            ids = self.encode_word(word)
            decimal, bytes_of = self.decimal, self.bytes_of
            entry = (len(ids), b" ".join([decimal[i] for i in ids]), b"".join([bytes_of[i] for i in ids]))
        if len(self.words) >= CACHED_WORDS:
            # Words not seen since the last turn are forgotten.
            self.older_words = dict(self.words)
            self.words.clear()
        self.words[word] = entry
        return entry

    def split(self, text: str) -> list[str]:
        """Words of a text: blanks and what follows up to the next blank; one blank is put in front."""
        marked = BLANK + text.replace(" ", BLANK)
        parts = marked.split(BLANK)
        if "" not in parts[1:]:
            return [BLANK + p for p in parts[1:]]
        words, run = [], 0
        for p in parts[1:]:
            run += 1
            if p:
                words.append(BLANK * run + p)
                run = 0
        if run:
            words.append(BLANK * run)
        return words

    def encode(self, text: str) -> list[int]:
        """All ids, the end id included."""
        ids = [i for word in self.split(text) for i in self.encode_word(word)] if text else []
        return [*ids, self.end_id]

    def decode(self, ids: list[int]) -> str:
        text = b"".join([self.bytes_of[i] for i in ids])
        return text[text[:1] == b" " :].decode("utf-8", "replace")

    def pieces(self, text: str) -> tuple[np.ndarray, str]:
        """All ids, the end id included, and the text they decode to; recent words are looked up."""
        known, unknown = self.words.get, self.word
        entries = [known(w) or unknown(w) for w in self.split(text)] if text else []
        ids = b" ".join([*[e[1] for e in entries], b"%d" % self.end_id])
        decoded = b"".join([e[2] for e in entries])
        return np.array(ids.split(), np.int32), decoded[decoded[:1] == b" " :].decode("utf-8", "replace")

    def digest(self, text: str) -> tuple[int, str, str]:
        """Number of ids, hash of the ids in decimal, hash of the decoded text."""
        known, unknown = self.words.get, self.word
        entries = [known(w) or unknown(w) for w in self.split(text)] if text else []
        ids = b" ".join([*[e[1] for e in entries], b"%d" % self.end_id])
        decoded = b"".join([e[2] for e in entries])
        decoded = decoded[decoded[:1] == b" " :]
        return (
            sum([e[0] for e in entries]) + 1,
            hashlib.sha256(ids).hexdigest(),
            hashlib.sha256(decoded).hexdigest(),
        )


_tables: dict[str, PieceTable] = {}


def piece_table(path: str) -> PieceTable:
    """The table of a model file, built once in each process."""
    if path not in _tables:
        _tables[path] = PieceTable(path)
    return _tables[path]


def encoded(documents: DataFrame, path: str) -> DataFrame:
    """``documents`` with ``ids array<int>`` and ``decoded`` added, for use as training input."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = piece_table(path)
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS_AT_ONCE):
                batch = whole.slice(start, ROWS_AT_ONCE)
                rows = [table.pieces(text or "") for text in batch.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array([r[0] for r in rows], pa.list_(pa.int32())), pa.array([r[1] for r in rows])],
                    names=[*batch.schema.names, "ids", "decoded"],
                )

    schema = documents.select("*", F.lit(None).cast("array<int>").alias("ids"), F.lit("").alias("decoded")).schema
    return documents.mapInArrow(run, schema)


def digests(documents: DataFrame, path: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = piece_table(path)
        for batch in batches:
            text = batch.column("text")
            rows = [table.digest(text[k].as_py() or "") for k in range(len(text))]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(np.array([r[0] for r in rows], np.int64)),
                    pa.array([r[1] for r in rows], pa.string()),
                    pa.array([r[2] for r in rows], pa.string()),
                ],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    rows = documents.select("doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
