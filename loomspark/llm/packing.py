"""Documents packed into training sequences of a fixed size by sums of squares.

A task keeps its partially filled windows by their level, the number of tokens in them. Each document goes to the
level at which the sum over all levels of the squared number of windows there becomes least, a new window being level
0: this keeps the levels even, so that a window of about any room is there, and full ones are never in the way. Of a
document larger than a window the first full windows are cut off, and what remains is placed.

Windows that are still partially filled at the end of a task fill each other: the fullest take the tokens that they
miss from the emptiest, where documents are cut. What then remains of the task, less than a window, becomes sequences
whose lengths are powers of two, which need no padding.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer, normalizers, pre_tokenizers

from loomspark.llm import pretoken
from loomspark.llm.bpe_trie import cleaned
from loomspark.llm.common import arrow, id_and_text, one_core, sliced

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
WINDOW = 2048
#: Partially filled windows that a task keeps at most: 4 bytes for each of their tokens.
OPEN = 1 << 12
#: Tasks number their sequences apart from each other.
SEQUENCES = 1 << 33


@dataclass
class Piece:
    doc_id: int | None
    start: int
    ids: np.ndarray
    doc_tokens: int

    def cut(self, n: int) -> tuple[Piece, Piece]:
        """The first n ids, and the others."""
        return Piece(self.doc_id, self.start, self.ids[:n], self.doc_tokens), Piece(self.doc_id, self.start + n, self.ids[n:], self.doc_tokens)


def filled(window: list[Piece]) -> int:
    return sum(len(p.ids) for p in window)


class Windows:
    """Windows of ``size`` tokens, partially filled, by level."""

    def __init__(self, size: int, most: int):
        self.size, self.most, self.n = size, most, 0
        self.at: list[list[list[Piece]]] = [[] for _ in range(size)]
        # twice the change of the sum of squares, but for a constant: a window leaves its level, and enters another
        self.leaves = np.full(size + 1, 1 << 40, np.int64)
        self.leaves[0] = 0
        self.enters = np.ones(size + 1, np.int64)
        self.enters[size] = 0

    def _counted(self, level: int) -> None:
        n = len(self.at[level])
        self.leaves[level] = 1 - 2 * n if n else 1 << 40
        self.enters[level] = 1 + 2 * n

    def level(self, n: int) -> int:
        """The level at which n more tokens make the sum of squares least; of equal ones the fullest."""
        change = self.leaves[: self.size - n + 1] + self.enters[n:]
        return self.size - n - int(np.argmin(change[::-1]))

    def add(self, piece: Piece) -> Iterator[list[Piece]]:
        """Place a piece of a window's size at most; the windows that it completes."""
        n = len(piece.ids)
        level = self.level(n)
        window = self._taken(level) if level else []
        window.append(piece)
        if level + n == self.size:
            yield window
            return
        self._put(window, level + n)
        if self.n > self.most:
            rest, full = self.poured()
            yield from full
            if rest:
                self._put(rest, filled(rest))

    def _taken(self, level: int) -> list[Piece]:
        window = self.at[level].pop()
        self.n -= 1
        self._counted(level)
        return window

    def _put(self, window: list[Piece], level: int) -> None:
        self.at[level].append(window)
        self.n += 1
        self._counted(level)

    def poured(self) -> tuple[list[Piece], list[list[Piece]]]:
        """All windows, which are partially filled no more: one that stays so, or nothing, and full ones. The fullest
        take what they miss from the emptiest."""
        waiting = [w for level in range(self.size - 1, 0, -1) for w in self.at[level]]
        for level in range(1, self.size):
            if self.at[level]:
                self.at[level] = []
                self._counted(level)
        self.n = 0
        full, first, last = [], 0, len(waiting) - 1
        while first < last:
            window, giver = waiting[first], waiting[last]
            room = self.size - filled(window)
            while room and giver:
                piece = giver.pop()
                if len(piece.ids) > room:
                    piece, rest = piece.cut(room)
                    giver.append(rest)
                window.append(piece)
                room -= len(piece.ids)
            if not giver:
                last -= 1
            if not room:
                full.append(window)
                first += 1
        rest = waiting[first] if first <= last else []
        return rest, full

    def end(self) -> Iterator[list[Piece]]:
        """Sequences of all that is left: full ones, and some whose lengths are powers of two."""
        rest, full = self.poured()
        yield from full
        rest = rest[::-1]
        left = filled(rest)
        while left:
            room = 1 << (left.bit_length() - 1)
            left -= room
            window = []
            while room:
                piece = rest.pop()
                if len(piece.ids) > room:
                    piece, other = piece.cut(room)
                    rest.append(other)
                window.append(piece)
                room -= len(piece.ids)
            yield window


@cache
def encoder(path: str) -> tuple[pretoken.WordIds, dict[str, int]]:
    """Ids of words that are cleaned and cut already, and those of the file's special strings."""
    one_core()
    words = Tokenizer.from_file(path)
    specials = {t.content: i for i, t in words.get_added_tokens_decoder().items()}
    words.no_truncation()
    words.no_padding()
    words.encode_special_tokens = True
    words.normalizer = normalizers.Sequence([])
    words.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    return pretoken.WordIds(lambda new: pretoken.encoded_words(words, new)), specials


def encoded(texts: list[str], path: str, end_id: int) -> list[np.ndarray]:
    """The ids of each text and the end id; long texts are encoded in parts."""
    words, specials = encoder(path)
    ids, sizes = pretoken.encoded_whole(texts, words, False, specials, cleaned)
    ends = np.cumsum(sizes)
    return np.split(np.insert(ids, ends, end_id), (ends + np.arange(1, len(texts) + 1))[:-1])


PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])


def packed_documents(docs: DataFrame, path: str = TOKENIZER, end_id: int = 1, size: int = WINDOW, most: int = OPEN) -> DataFrame:
    """doc_id, start, ids, doc_tokens, sequence_id, offset: the pieces of all documents (doc_id, text), each of whose
    ids and end id are in exactly one piece.

    ids: little-endian unsigned 32-bit integers; start: the document's ids before them; doc_tokens: all of its ids;
    sequence_id, offset: the sequence and the place in it. Sequences have ``size`` tokens or a power of two below it, the
    latter 11 or so in a task, so that none needs padding. Null and empty texts are the end id alone; repeated rows are
    packed each, with null ids too; other columns are ignored. A long text is encoded in parts cut between words, and
    its full windows stand alone. No row leaves its partition, and a task holds ``most`` partially filled windows at
    most: beyond that they fill each other. No rows: no pieces.
    """

    def pack(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() * SEQUENCES
        windows = Windows(size, most)
        rows: list[tuple] = []

        def close(window: list[Piece]) -> None:
            nonlocal number
            at = 0
            for p in window:
                rows.append((p.doc_id, p.start, p.ids.astype("<u4").tobytes(), p.doc_tokens, number, at))
                at += len(p.ids)
            number += 1

        def sent():
            out = arrow(dict(zip(PIECES.names, map(list, zip(*rows)))), PIECES)
            rows.clear()
            return out

        for batch in sliced(batches):
            doc_ids = batch.column(0).to_pylist()
            for doc_id, ids in zip(doc_ids, encoded(batch.column(1).to_pylist(), path, end_id)):
                whole = len(ids) // size * size
                for a in range(0, whole, size):
                    close([Piece(doc_id, a, ids[a : a + size], len(ids))])
                if whole < len(ids):
                    for window in windows.add(Piece(doc_id, whole, ids[whole:].copy(), len(ids))):
                        close(window)
            if rows:
                yield sent()
        for window in windows.end():
            close(window)
        if rows:
            yield sent()

    docs = id_and_text(docs).select(F.col("doc_id").cast("long"), "text")
    return docs.mapInArrow(pack, "doc_id long, start long, ids binary, doc_tokens long, sequence_id long, offset long")


def packing_digests(docs: DataFrame, path: str = TOKENIZER, end_id: int = 1, size: int = WINDOW) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of each piece."""
    pieces = packed_documents(docs, path, end_id, size)
    return pieces.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("length"), F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
