"""Which tokens of two tokenizers belong together: each text's ids in both, aligned by the bytes that they cover.

The tokens of B are intervals of a text's bytes that follow each other, so that their ends, in order, are a static
index of them. Each token of A is a query: two bisections give the first and the last token of B that it meets. Where
the last one ends with the query, nothing spans the gap between two bytes, and a group of tokens ends there. A and B
tokens that end together are linked, and how often a pair of ids is linked in all texts tells how well they fit.

Texts are written once with the pairs of ids that they link. The most frequent pairs, a fixed number, are broadcast
with their counts; of the others each text's pairs meet their counts in a join.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor

from loomspark.llm import pretoken
from loomspark.llm.bpe_trie import byte_letters
from loomspark.llm.common import arrow, id_and_text, sliced, through_table
from loomspark.llm.token_counts import loaded

BYTES = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
#: Pairs of ids whose counts are broadcast at most: 17 bytes each.
HEAD = 1 << 18
#: Characters that are encoded at a time, and pairs that a task counts before it sends them on.
BLOCK, COUNTED = 1 << 18, 1 << 20
#: Tasks number their rows apart from each other.
ROWS = 1 << 33


@dataclass
class Vocabulary:
    """A tokenizer's ids of words, kept from batch to batch, and the bytes that each id stands for. bad: the id given
    in place of a word whose tokens do not spell it."""

    spelt: list[bytes]
    words: pretoken.WordIds = field(init=False)

    def __post_init__(self) -> None:
        self.bad = len(self.spelt)
        self.sizes = np.array([*map(len, self.spelt), 0], np.int64)
        self.words = pretoken.WordIds(self.checked)

    def checked(self, words: list[str]) -> list[list[int]]:
        return [ids if b"".join(map(self.spelt.__getitem__, ids)) == w.encode() else [self.bad] for w, ids in zip(words, self.encode(words))]

    def of(self, pieces: pretoken.Pieces, n: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids of n texts end to end, and the text that each is of."""
        if not len(pieces.code):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        slots = self.words.of(pieces)[pieces.code]
        lengths = self.words.length[slots]
        return self.words.ids[pretoken.ragged(self.words.begin[slots], lengths)].astype(np.int64), np.repeat(pieces.text, lengths)


class ByteVocabulary(Vocabulary):
    """The tokens of a byte-level vocabulary; strings of special tokens are ordinary text."""

    def __init__(self, path: str):
        self.tokenizer, _ = loaded(path)
        byte_of = {c: b for b, c in enumerate(byte_letters())}
        names = {i: t for t, i in self.tokenizer.get_vocab(with_added_tokens=False).items()}
        super().__init__([bytes(map(byte_of.__getitem__, names.get(i, ""))) for i in range(max(names) + 1)])

    def encode(self, words: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def split(self, texts: list[str]) -> pretoken.Pieces:
        return pretoken.split(texts, True)


class PieceVocabulary(Vocabulary):
    """The pieces of a sentencepiece vocabulary in which a blank only begins a piece or fills it, so that none spans
    the gap between another character and a blank: what begins there is encoded by itself."""

    def __init__(self, path: str):
        self.model = SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        if any("▁" in name.strip("▁") or name.endswith("▁") and name.strip("▁") for name in names):
            raise ValueError("a piece of this vocabulary has a blank after another character")
        self.blank = [self.model.piece_to_id("▁")]
        super().__init__([bytes([int(name[1:-1], 16)]) if self.model.is_byte(i) else name.replace("▁", " ").encode() for i, name in enumerate(names)])

    def encode(self, words: list[str]) -> list[list[int]]:
        """Each word begins with the blank that the model itself puts before a text."""
        found = self.model.encode([w[1:] for w in words], num_threads=1)
        return [ids if len(w) > 1 else self.blank for w, ids in zip(words, found)]

    def split(self, texts: list[str]) -> pretoken.Pieces:
        """Words with the blanks before them. Each text begins with a blank."""
        joined = "".join(texts)
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        start = points == 0x20
        start[1:] &= points[:-1] != 0x20
        start[(np.cumsum(sizes) - sizes)[sizes > 0]] = True
        starts = np.flatnonzero(start)
        return pretoken.pieces_at(joined, points, starts, np.append(starts[1:], len(points)), sizes)


@cache
def vocabularies(a: str, b: str) -> tuple[Vocabulary, Vocabulary]:
    return ByteVocabulary(a), PieceVocabulary(b)


@dataclass
class Aligned:
    """Tokens of n texts in two vocabularies, end to end. a, b: ids; text_a, text_b: the text of each; first, last: the
    first and last token of b that each token of a meets; group_a, group_b: the number of each token's group."""

    n: int
    a: np.ndarray
    b: np.ndarray
    text_a: np.ndarray
    text_b: np.ndarray
    first: np.ndarray
    last: np.ndarray
    closes: np.ndarray
    group_a: np.ndarray
    group_b: np.ndarray

    @classmethod
    def of(cls, n: int, a: np.ndarray, text_a: np.ndarray, sizes_a: np.ndarray, b: np.ndarray, text_b: np.ndarray, sizes_b: np.ndarray) -> Aligned:
        """sizes: bytes of each token. Both sides cover the same bytes of each text."""
        end_a, end_b = np.cumsum(sizes_a), np.cumsum(sizes_b)
        first = np.searchsorted(end_b, end_a - sizes_a, side="right")
        last = np.searchsorted(end_b, end_a, side="left")
        closes = end_b[last] == end_a if len(b) else np.zeros(0, bool)
        group_a = np.cumsum(closes) - closes
        group_b = np.searchsorted(last[closes], np.arange(len(b)), side="left")
        return cls(n, a, b, text_a, text_b, first, last, closes, group_a, group_b)

    def overlaps(self) -> tuple[np.ndarray, np.ndarray]:
        """The places in a and b of all tokens that share a byte."""
        lengths = self.last - self.first + 1
        return np.repeat(np.arange(len(self.a)), lengths), pretoken.ragged(self.first, lengths)

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """The places in a and b of all tokens that end together."""
        at = np.flatnonzero(self.closes)
        return at, self.last[at]

    def spelt_groups(self) -> tuple[np.ndarray, np.ndarray]:
        """`a1,a2|b1;a3|b2;` for each group, as bytes, and the text that each byte is of."""
        n_a, n_b = len(self.a), len(self.b)
        ids, texts, after = np.zeros(n_a + n_b, np.int64), np.zeros(n_a + n_b, np.int64), np.zeros(n_a + n_b, np.uint8)
        # a token comes after its own side's and the other side's of earlier groups, those of b after those of a too
        at_a = np.arange(n_a) + np.searchsorted(self.group_b, self.group_a, side="left")
        at_b = np.arange(n_b) + np.searchsorted(self.group_a, self.group_b, side="right")
        for at, id_, text, group, end in ((at_a, self.a, self.text_a, self.group_a, b"|"), (at_b, self.b, self.text_b, self.group_b, b";")):
            ids[at], texts[at] = id_, text
            after[at] = np.where(np.append(group[1:] != group[:-1], True), end[0], ord(","))
        digits = len(str(int(ids.max(initial=0))))
        letters = np.zeros((len(ids), digits + 1), np.uint8)
        rest = ids.copy()
        for k in range(digits - 1, -1, -1):
            letters[:, k] = rest % 10 + 48
            if k < digits - 1:
                letters[rest == 0, k] = 0
            rest //= 10
        letters[:, digits] = after
        there = letters != 0
        return letters[there], np.repeat(texts, there.sum(1))


def aligned(texts: list[str], a: Vocabulary, b: Vocabulary) -> tuple[Aligned, np.ndarray]:
    """The alignment of texts that begin with a blank, and which of them a vocabulary does not spell: they have no
    tokens."""
    (ids_a, text_a), (ids_b, text_b) = (v.of(v.split(texts), len(texts)) for v in (a, b))
    bad = np.zeros(len(texts), bool)
    bad[text_a[ids_a == a.bad]] = True
    bad[text_b[ids_b == b.bad]] = True
    if bad.any():
        keep_a, keep_b = ~bad[text_a], ~bad[text_b]
        ids_a, text_a, ids_b, text_b = ids_a[keep_a], text_a[keep_a], ids_b[keep_b], text_b[keep_b]
    return Aligned.of(len(texts), ids_a, text_a, a.sizes[ids_a], ids_b, text_b, b.sizes[ids_b]), bad


def distinct_counts(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found, back = np.unique(values, return_inverse=True)
    total = np.zeros(len(found), np.int64)
    np.add.at(total, back, counts)
    return found, total


class Text:
    """What is known of one text after some of its parts."""

    def __init__(self) -> None:
        self.n_a = self.n_b = self.n_groups = 0
        self.bad, self.digest = False, hashlib.sha256()
        self.pending = b""
        self.pairs, self.times = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, n_a: int, n_b: int, n_groups: int, bad: bool, groups: memoryview, pairs: np.ndarray, times: np.ndarray) -> None:
        self.n_a, self.n_b, self.n_groups, self.bad = self.n_a + n_a, self.n_b + n_b, self.n_groups + n_groups, self.bad or bad
        if len(groups):
            self.digest.update(self.pending)
            self.digest.update(groups[:-1])
            self.pending = bytes(groups[-1:])
        self.pairs, self.times = (pairs, times) if not len(self.pairs) else distinct_counts(np.concatenate([self.pairs, pairs]), np.concatenate([self.times, times]))

    def row(self, kind: np.dtype) -> tuple:
        if self.bad or not self.n_a:
            return NOTHING
        return self.n_a, self.n_b, self.n_groups, self.digest.hexdigest(), self.pairs.astype(kind).tobytes(), self.times.astype("<u4").tobytes()


def pair_type(a: str, b: str) -> np.dtype:
    """The type in which a pair of ids, a * (ids of b) + b, is kept."""
    one, two = vocabularies(a, b)
    return np.dtype("<u4" if len(one.spelt) * len(two.spelt) <= 1 << 32 else "<i8")


NOTHING = (0, 0, 0, "", b"", b"")


PARTS = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("groups_sha256", pa.string()), ("pairs", pa.binary()), ("times", pa.binary())])
PARTS_SQL = "row long, doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, pairs binary, times binary"
COUNTS = pa.schema([("pair", pa.int64()), ("count", pa.int64())])
MET = pa.schema([("row", pa.int64()), ("count_sum", pa.int64()), ("n_best", pa.int64()), ("pair", pa.int64()), ("times", pa.int64())])


def aligned_texts(docs: DataFrame, a: str, b: str, block: int) -> DataFrame:
    """row, doc_id, n_a, n_b, n_groups, groups_sha256, pairs, times: a row for each row of ``docs``; pairs and times:
    the distinct linked pairs of ids, ascending integers of ``pair_type``, and how often each is linked, as 32-bit ones."""

    def compute(batches):
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() * ROWS
        one, two = vocabularies(a, b)
        base, kind = len(two.spelt), pair_type(a, b)
        for batch in sliced(batches):
            texts: list[Text | None] = [None] * batch.num_rows
            out: list[tuple] = [NOTHING] * batch.num_rows
            for rows, found in pretoken.part_blocks((" " + t if t else "" for t in batch.column(1).to_pylist()), block):
                here, bad = aligned(found, one, two)
                n = len(found)
                n_a, n_b = np.bincount(here.text_a, minlength=n), np.bincount(here.text_b, minlength=n)
                at_a, at_b = here.links()
                text = here.text_a[at_a]
                n_groups = np.bincount(text, minlength=n)
                # sorted by text and pair: each text's distinct pairs are a run
                pairs = here.a[at_a] * base + here.b[at_b]
                order = np.lexsort((pairs, text))
                text, pairs = text[order], pairs[order]
                new = np.append(True, (text[1:] != text[:-1]) | (pairs[1:] != pairs[:-1]))[: len(pairs)]
                first = np.flatnonzero(new)
                times = np.diff(np.append(first, len(pairs)))
                text, pairs = text[first], pairs[first]
                edge = np.searchsorted(text, np.arange(n + 1)).tolist()
                letters, of = here.spelt_groups()
                spelt = memoryview(letters)
                cut = np.searchsorted(of, np.arange(n + 1)).tolist()
                for k, r in enumerate(rows):
                    if texts[r] is None:
                        texts[r] = Text()
                    texts[r].add(int(n_a[k]), int(n_b[k]), int(n_groups[k]), bool(bad[k]), spelt[cut[k] : cut[k + 1]], pairs[edge[k] : edge[k + 1]], times[edge[k] : edge[k + 1]])
                for r in set(rows[:-1]) - {rows[-1]}:  # the last one may go on
                    out[r], texts[r] = texts[r].row(kind), None
            for r, t in enumerate(texts):
                if t is not None:
                    out[r] = t.row(kind)
            columns = list(zip(*out))
            yield arrow(dict(zip(PARTS.names, [np.arange(row, row + len(out)), batch.column(0), *map(list, columns)])), PARTS)
            row += len(out)

    return docs.mapInArrow(compute, PARTS_SQL)


def pair_counts(texts: DataFrame, kind: np.dtype, base: int) -> DataFrame:
    """pair, count, best: how often each pair of ids is linked in all texts, and whether no pair of its id of b is
    linked more often."""

    def compute(batches):
        waiting: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def total():
            return distinct_counts(*(np.concatenate(x) for x in zip(*waiting)))

        for batch in sliced(batches):
            pairs = np.frombuffer(b"".join(batch.column(0).to_pylist()), kind).astype(np.int64)
            times = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<u4").astype(np.int64)
            waiting.append((pairs, times))
            size += len(pairs)
            if size >= COUNTED:
                waiting = [total()]
                size = len(waiting[0][0])
                if size >= COUNTED // 2:
                    yield arrow(dict(zip(COUNTS.names, waiting[0])), COUNTS)
                    waiting, size = [], 0
        if waiting:
            yield arrow(dict(zip(COUNTS.names, total())), COUNTS)

    counted = texts.select("pairs", "times").mapInArrow(compute, "pair long, count long").groupBy("pair").agg(F.sum("count").alias("count"))
    counted = through_table(counted, "pair-counts")
    of_b = F.col("pair") % base
    most = counted.groupBy(of_b.alias("b")).agg(F.max("count").alias("most"))  # a row for each id of b at most
    return counted.withColumn("b", of_b).join(most, "b").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def head_of(pairs: DataFrame, most: int) -> pd.DataFrame:
    """The most frequent pairs: at most ``most`` rows, whatever the corpus, chosen by a power of two."""
    powers = pairs.groupBy(F.floor(F.log2("count")).cast("int").alias("power")).count().orderBy(F.desc("power")).collect()
    least, total = None, 0
    for row in powers:
        if (total := total + row["count"]) > most:
            break
        least = 1 << row["power"]
    return pairs.filter(F.lit(False) if least is None else F.col("count") >= least).toPandas().sort_values("pair")


def token_alignment(docs: DataFrame, a: str = BYTES, b: str = PIECES, head: int = HEAD, block: int = BLOCK) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256: one row for each row of ``docs``
    (doc_id, text), aligning the tokens of a blank and the text in a byte-level vocabulary and in a sentencepiece one.

    n_links counts tokens of A and B that end together; each group of tokens ends with one such pair. n_best: those
    whose pair of ids is linked in all texts as often as any pair of that id of B; count_sum: how often, summed over the
    links. groups_sha256 is that of the groups' ids, empty without tokens. Null and empty texts and texts that a
    vocabulary does not spell byte by byte have no tokens and no part in the counts. Repeated rows count each; null ids
    stay; other columns are ignored. A long text is aligned in parts of ``block`` characters, cut where no token is; one
    without a single blank between other characters is encoded whole. No rows: no rows.
    """
    spark = docs.sparkSession
    base, kind = len(vocabularies(a, b)[1].spelt), pair_type(a, b)
    docs = id_and_text(docs).select(F.col("doc_id").cast("long"), "text")
    texts = through_table(aligned_texts(docs, a, b, block), "aligned-texts")
    pairs = through_table(pair_counts(texts, kind, base), "best-pairs")
    top = head_of(pairs, head)
    shared = spark.sparkContext.broadcast((top["pair"].to_numpy(np.int64), np.append(top["count"].to_numpy(np.int64), 0), np.append(top["best"].to_numpy(bool), False)))

    def meet(batches):
        keys, count, best = shared.value
        for batch in sliced(batches):
            row = batch.column(0).to_numpy(zero_copy_only=False)
            found = batch.column(1).to_pylist()
            pair = np.frombuffer(b"".join(found), kind).astype(np.int64)
            times = np.frombuffer(b"".join(batch.column(2).to_pylist()), "<u4").astype(np.int64)
            of = np.repeat(np.arange(len(row)), [len(x) // kind.itemsize for x in found])
            at = np.searchsorted(keys, pair)
            known = keys[np.minimum(at, len(keys) - 1)] == pair if len(keys) else np.zeros(len(pair), bool)
            at = np.where(known, at, len(keys))
            count_sum, n_best = np.zeros(len(row), np.int64), np.zeros(len(row), np.int64)
            np.add.at(count_sum, of, times * count[at])
            np.add.at(n_best, of, times * best[at])
            n = len(row)
            yield arrow({"row": row, "count_sum": count_sum, "n_best": n_best, "pair": pa.nulls(n, pa.int64()), "times": pa.nulls(n, pa.int64())}, MET)
            rare = ~known
            n = int(rare.sum())
            yield arrow({"row": row[of[rare]], "count_sum": pa.nulls(n, pa.int64()), "n_best": pa.nulls(n, pa.int64()), "pair": pair[rare], "times": times[rare]}, MET)

    met = through_table(texts.select("row", "pairs", "times").mapInArrow(meet, "row long, count_sum long, n_best long, pair long, times long"), "met-pairs")
    rare = met.filter("pair is not null").select("row", "pair", "times").join(pairs, "pair")
    rare = rare.select("row", (F.col("times") * F.col("count")).alias("count_sum"), F.when(F.col("best"), F.col("times")).otherwise(0).cast("long").alias("n_best"))
    sums = met.filter("pair is null").select("row", "count_sum", "n_best").unionByName(rare).groupBy("row").agg(F.sum("count_sum").alias("count_sum"), F.sum("n_best").alias("n_best"))
    columns = texts.select("row", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256")
    return columns.join(sums, "row").select("doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), "n_best", "count_sum", "groups_sha256")
