"""Benchmark decontamination: item-sized windows of documents, by SimHash and then exactly.

Words are runs of letters and digits in lower case. A window has as many words as an item, or all of a document that
has fewer. Its fingerprint comes from rolling sums of its shingles' bits and probes an index of the fingerprints of
the items of its size: these are cut into blocks, and two fingerprints within the radius are within radius / blocks
bits in one block at least, so that the blocks' neighbours give all of them. What the index gives is verified by the
weighted Jaccard similarity of the shingles themselves. Windows that hold no shingle of any item of their size are
passed over: their similarity is 0 to all.

The benchmark is held by every task, in blocks of ``BLOCK_BYTES`` of items; a task holds ``HELD_BYTES`` of its texts
while one block after the other is matched with them, so that documents are read once whatever the benchmark.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.llm import pretoken
from loomspark.llm.common import id_and_text, sliced

WIDTH = 5
SIMILARITY = 0.8
#: Bits of 64. Fingerprints of windows at the similarity of 0.8 differ in 10 on average, with a deviation of 3.
RADIUS = 24
BLOCKS = 16
BLOCK_BYTES = 8 << 20
HELD_BYTES = 64 << 20
MIXER = np.uint64(0xD6E8FEB86659FD93)


class Words:
    """The words of a batch of texts: their hashes, the text each is of, and where they stand."""

    def __init__(self, texts: list[str]):
        lower = [t.lower() for t in texts]
        self.joined = "".join(lower)
        points = np.frombuffer(self.joined.encode("utf-32-le"), np.uint32)
        sizes = np.fromiter(map(len, lower), np.int64, len(lower))
        begins = np.cumsum(sizes) - sizes
        kind = pretoken.classes()[points]
        inside = (kind == pretoken.LETTER) | (kind == pretoken.NUMBER)
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        edge = begins[(sizes > 0)]
        first[edge] = inside[edge]
        last[edge[1:] - 1] = inside[edge[1:] - 1]
        self.starts, self.ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.hashes = pretoken.span_hashes(pretoken.symbol_values()[points], self.starts, self.ends) if len(points) else np.zeros(0, np.uint64)
        self.text = np.searchsorted(begins + sizes, self.starts, side="right")

    def shingles(self, width: int) -> np.ndarray:
        """A hash of the words from each word on; 0 where the text ends before ``width`` words."""
        n = max(0, len(self.hashes) - width + 1)
        out = np.zeros(n, np.uint64)
        for k in range(width):
            out = pretoken.mixed(out * MIXER + self.hashes[k : k + n])
        return np.where(self.text[:n] == self.text[width - 1 : width - 1 + n], out, np.uint64(0))

    def between(self, a: int, b: int) -> list[str]:
        return [self.joined[i:j] for i, j in zip(self.starts[a:b].tolist(), self.ends[a:b].tolist())]


def bits_of(hashes: np.ndarray) -> np.ndarray:
    return np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def simhash(hashes: np.ndarray) -> int:
    return int(window_fingerprints(hashes, len(hashes))[0])


def window_fingerprints(hashes: np.ndarray, size: int) -> np.ndarray:
    """The SimHash of each window of ``size`` hashes, by differences of running sums: bits set in over half of them."""
    sums = np.zeros((len(hashes) + 1, 64), np.int32)
    np.cumsum(bits_of(hashes), axis=0, out=sums[1:])
    return np.packbits(2 * (sums[size:] - sums[:-size]) > size, axis=1, bitorder="little").view("<u8").ravel()


def similarity(a: Counter, b: Counter) -> float:
    shared = sum(min(n, b[s]) for s, n in a.items())
    return shared / (sum(a.values()) + sum(b.values()) - shared)


def shingle_counts(words: list[str], width: int) -> Counter:
    return Counter(tuple(words[i : i + width]) for i in range(len(words) - width + 1))


@cache
def neighbours(bits: int, radius: int) -> list[int]:
    return [sum(1 << b for b in c) for k in range(radius + 1) for c in combinations(range(bits), k)]


class HammingBlocks:
    """Fingerprints by their blocks: gives all within the radius of a query."""

    def __init__(self, fingerprints: list[tuple[int, int]], radius: int):
        self.radius, self.size = radius, 64 // BLOCKS
        self.names = np.array([n for n, _ in fingerprints], np.int64)
        self.fingerprints = np.array([f for _, f in fingerprints], np.uint64)
        flips = np.array(neighbours(self.size, radius // BLOCKS), np.uint64)
        self.tables = []
        for k in range(BLOCKS):  # by value of the block: those whose own block is a neighbour
            values = (self._block(self.fingerprints, k)[:, None] ^ flips).ravel()
            order = np.argsort(values, kind="stable")
            self.tables.append((np.searchsorted(values[order], np.arange((1 << self.size) + 1)), (order // len(flips)).astype(np.int32)))

    def _block(self, f: np.ndarray, k: int) -> np.ndarray:
        return f >> np.uint64(k * self.size) & np.uint64((1 << self.size) - 1)

    def pairs(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, name) of each pair within the radius, in order of the queries."""
        found = []
        step = max(1, (1 << 20) // (len(self.names) * BLOCKS))
        for a in range(0, len(queries), step):
            part, met = queries[a : a + step], []
            for k, (begin, rows) in enumerate(self.tables):
                value = self._block(part, k).astype(np.int64)
                many = begin[value + 1] - begin[value]
                met.append(np.repeat(np.arange(len(part)), many) * len(self.names) + rows[pretoken.ragged(begin[value], many)])
            query, row = np.divmod(np.unique(np.concatenate(met)), len(self.names))
            near = np.bitwise_count(part[query] ^ self.fingerprints[row]) <= self.radius
            found.append((query[near] + a, self.names[row[near]]))
        return (np.concatenate([q for q, _ in found]), np.concatenate([n for _, n in found])) if found else (np.zeros(0, np.int64), self.names[:0])

    def near(self, f: int) -> list[int]:
        return sorted(self.pairs(np.array([f], np.uint64))[1].tolist())


class Benchmark:
    """Items ready for matching; an item without words matches nothing."""

    def __init__(self, items: list[tuple[int, str]], width: int = WIDTH, least: float = SIMILARITY, radius: int = RADIUS):
        self.least, self.items = least, items
        words = Words([t for _, t in items])
        spans = np.searchsorted(words.text, np.arange(len(items) + 1))
        self.n_words = np.diff(spans)
        self.width = np.minimum(self.n_words, width)
        self.counts: list[Counter] = []
        found: dict[int, list[tuple[int, int]]] = {}  # width: (shingle hash, item)
        by_size: dict[int, list[tuple[int, int]]] = {}
        every = {w: words.shingles(w) for w in set(self.width.tolist()) if w}
        for i, (a, b) in enumerate(zip(spans[:-1].tolist(), spans[1:].tolist())):
            w = int(self.width[i])
            self.counts.append(shingle_counts(words.between(a, b), w) if w else Counter())
            if w:
                hashes = every[w][a : b - w + 1]
                found.setdefault(w, []).extend((h, i) for h in set(hashes.tolist()))
                by_size.setdefault(b - a, []).append((i, simhash(hashes)))
        # the shingles of each width, and by shingle the numbers of words of the items that have it
        self.lookup = {}
        for w, pairs in found.items():
            sized = sorted({(h, int(self.n_words[i])) for h, i in pairs})
            self.lookup[w] = np.array([h for h, _ in sized], np.uint64), np.array([n for _, n in sized], np.int64)
        self.index = {n: HammingBlocks(f, radius) for n, f in by_size.items()}

    def matches(self, texts: list[str]) -> Iterator[tuple[int, int, float, int]]:
        """(text, item, similarity, first word) of the most similar window of each text and item that match."""
        words = Words(texts)
        offsets = np.searchsorted(words.text, np.arange(len(texts) + 1))
        for width, (keys, sizes) in self.lookup.items():
            shingles = words.shingles(width)
            begin = np.searchsorted(keys, shingles)
            hit = np.flatnonzero((keys[np.minimum(begin, len(keys) - 1)] == shingles) & (shingles != 0))
            if not len(hit):
                continue
            many = np.searchsorted(keys, shingles[hit], side="right") - begin[hit]
            at = np.repeat(hit, many)
            size = sizes[pretoken.ragged(begin[hit], many)]
            text = words.text[at]
            order = np.lexsort((at, size, text))
            at, size, text = at[order], size[order], text[order]
            edges = np.flatnonzero(np.concatenate([[True], (size[1:] != size[:-1]) | (text[1:] != text[:-1])]))
            best: dict[tuple[int, int], tuple[float, int]] = {}
            for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(at)]):
                t = int(text[a])
                for item, found, start in self._windows(words, shingles, at[a:b], int(size[a]), width, int(offsets[t]), int(offsets[t + 1])):
                    if found >= self.least and found > best.get((t, item), (0, 0))[0]:
                        best[t, item] = found, start
            for (t, item), (found, start) in sorted(best.items()):
                yield t, item, found, int(start - offsets[t])

    def _windows(self, words: Words, shingles: np.ndarray, places: np.ndarray, size: int, width: int, begin: int, end: int) -> Iterator[tuple[int, float, int]]:
        """(item, similarity, first word) of the windows of ``size`` words that the index gives. places: of the text's
        shingles that items of this size have."""
        n = min(size, end - begin)  # a shorter text is one window
        m = n - width + 1
        first = np.maximum(places - m + 1, begin)
        last = np.minimum(places, end - n)
        # stretches of windows that hold such a place, joined where they meet
        new = np.flatnonzero(np.concatenate([[True], first[1:] > last[:-1] + 1]))
        for a, b in zip(first[new].tolist(), last[np.append(new[1:], len(last)) - 1].tolist()):
            query, item = self.index[size].pairs(window_fingerprints(shingles[a : b + m], m))
            last_query = -1
            for q, i in zip(query.tolist(), item.tolist()):
                if q != last_query:
                    mine, last_query = shingle_counts(words.between(a + q, a + q + n), width), q
                yield i, similarity(mine, self.counts[i]), a + q


def item_blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple[int, str]]]:
    """The benchmark's items, in blocks of about ``block_bytes``; the same item twice counts once."""
    items = benchmark.select(F.col("item_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).distinct()
    total = items.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0))).first()[0]
    n = max(1, -(-total // block_bytes))
    for k in range(n):
        rows = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).collect()
        yield sorted(((r["item_id"], r["text"]) for r in rows), key=repr)


_ready: dict[str, Benchmark] = {}


def _benchmark(shared, options: tuple) -> Benchmark:
    """The block that a broadcast holds, made ready once in each worker."""
    key = f"{shared.value[0]} {options}"
    if key not in _ready:
        _ready.clear()
        _ready[key] = Benchmark(shared.value[1], *options)
    return _ready[key]


def _shared(spark, items: list[tuple[int, str]]):
    return spark.sparkContext.broadcast((uuid.uuid4().hex, items))


def held(batches: Iterator[pa.RecordBatch], blocks: int) -> Iterator[list[pa.RecordBatch]]:
    """Lists of batches of HELD_BYTES; single batches if there is one block of items."""
    waiting, total = [], 0
    for batch in sliced(batches):
        waiting.append(batch)
        total += batch.nbytes
        if blocks == 1 or total > HELD_BYTES:
            yield waiting
            waiting, total = [], 0
    if waiting:
        yield waiting


def contaminated(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, least: float = SIMILARITY, radius: int = RADIUS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, item_id, similarity, first_word: each document and benchmark item that match, with the best window.

    An item of fewer than ``width`` words is one shingle. Null texts and items without words match nothing; rows
    of equal or null doc_id each have their own matches. No matches, or empty tables, give no rows.
    """
    rows = id_and_text(docs).select(F.col("doc_id").cast("long"), "text")
    arrow_schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("similarity", pa.float64()), ("first_word", pa.int64())])
    blocks = [_shared(docs.sparkSession, items) for items in item_blocks(benchmark, block_bytes)]

    def match(batches):
        for some in held(batches, len(blocks)):
            for shared in blocks:
                block = _benchmark(shared, (width, least, radius))
                for batch in some:
                    texts = batch.column(1).to_pylist()
                    for a, b in pretoken.blocks(texts):
                        rows = [(a + t, block.items[i][0], s, p) for t, i, s, p in block.matches(texts[a:b])]
                        if rows:
                            t, i, s, p = zip(*rows)
                            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(t)), pa.array(i, pa.int64()), pa.array(s), pa.array(p, pa.int64())], schema=arrow_schema)

    return rows.mapInArrow(match, "doc_id long, item_id long, similarity double, first_word long")


def without_benchmark(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, least: float = SIMILARITY, radius: int = RADIUS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs``, all columns unchanged whatever their names, whose text matches no benchmark item. No row
    is moved. Null and empty texts match nothing and stay, very long ones are read whole, repeated rows share a fate,
    and an empty table gives no rows."""
    at = docs.columns.index("text")
    blocks = [_shared(docs.sparkSession, items) for items in item_blocks(benchmark, block_bytes)]

    def keep(batches):
        for some in held(batches, len(blocks)):
            clean = [np.ones(batch.num_rows, bool) for batch in some]
            for shared in blocks:
                block = _benchmark(shared, (width, least, radius))
                for batch, mine in zip(some, clean):
                    texts = [t or "" for t in batch.column(at).to_pylist()]
                    for a, b in pretoken.blocks(texts):
                        for t, *_ in block.matches(texts[a:b]):
                            mine[a + t] = False
            yield from (batch.filter(pa.array(mine)) for batch, mine in zip(some, clean))

    return docs.mapInArrow(keep, docs.schema)
