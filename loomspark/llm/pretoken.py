"""Vectorised pre-tokenisation: many texts at once as one array of code points.

Both public word splitters are runs of letters, digits and other symbols with a few exceptions, so that
array comparisons find the boundaries of all pieces of a batch without a regular expression. Each piece has
a 64-bit hash, by which a batch's distinct pieces are found.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
from tokenizers import Regex, Tokenizer
from tokenizers.pre_tokenizers import Split

SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3
#: The code points of the Unicode property White_Space.
WHITE_SPACE = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
BASE = np.uint64(0x9E3779B97F4A7C15)
MASK = (1 << 64) - 1


def mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@cache
def classes() -> np.ndarray:
    """The class of every code point."""
    table = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x40000)]))  # no letters or digits are beyond
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):  # by the tokenizers' own Unicode tables
        for found, _ in Split(Regex(pattern), "removed", invert=True).pre_tokenize_str(every):
            table[np.frombuffer(found.encode("utf-32-le"), np.uint32)] = kind
    table[WHITE_SPACE] = SPACE
    return table


@cache
def symbol_values() -> np.ndarray:
    return mixed(np.arange(1, sys.maxunicode + 2, dtype=np.uint64) * BASE)


_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash's base and of its inverse."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 16)
        inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
        _powers[:] = [np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size - 1, b, np.uint64))]) for b in (BASE, inverse)]
    return _powers[0][:n], _powers[1][:n]


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit polynomial hash of values[start:end] for each span, by differences of one prefix sum."""
    power, inverse = powers(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * power[: len(values)], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))


@dataclass
class Pieces:
    """Pieces of a batch of texts, in order. text[i]: which text piece i is of; code[i]: its distinct piece."""

    text: np.ndarray
    code: np.ndarray
    hashes: np.ndarray
    joined: str
    spans: np.ndarray

    def words(self, which: np.ndarray | None = None) -> list[str]:
        """The distinct pieces with these codes, or all of them."""
        spans = self.spans if which is None else self.spans[which]
        return [self.joined[a:b] for a, b in spans.tolist()]


def _starts(points: np.ndarray, begins: np.ndarray, joins_space: bool) -> tuple[np.ndarray, np.ndarray]:
    """Where pieces start and end. begins: the index at which each text begins. joins_space: a blank before a run
    belongs to it and other white space forms pieces; otherwise white space is dropped and digits stand alone."""
    n = len(points)
    kind = classes()[points]
    opens = np.zeros(n + 3, bool)  # a text begins here
    opens[begins] = True
    opens[n:] = True
    run = opens[:n].copy()
    run[1:] |= kind[1:] != kind[:-1]
    at = np.flatnonzero(run)
    solid = at[kind[at] != SPACE]
    inner = solid[(solid > 0) & ~opens[solid]]
    after_space = inner[kind[inner - 1] == SPACE]
    start = run.copy()
    if joins_space:
        start[after_space - 1] = True
        start[after_space[points[after_space - 1] == 0x20]] = False
    else:
        start[kind == SPACE] = False
        start |= kind == NUMBER
    padded = np.concatenate([points, np.zeros(3, points.dtype)])
    # 's 't 'm 'd 're 've 'll after an apostrophe that begins a piece of its own
    mark = np.flatnonzero((points == 0x27) & start[:n])
    mark = mark[(np.append(kind, SPACE)[mark + 1] == LETTER) & ~opens[mark + 1]]
    if len(mark):
        one, two = padded[mark + 1], np.where(opens[mark + 2], 0, padded[mark + 2])
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ~short & (((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l")))
        start[mark[short | long] + 1] = False
        next_at = np.concatenate([mark[short] + 2, mark[long] + 3])
        next_at = next_at[next_at < n]
        start[next_at] = True if joins_space else (kind[next_at] != SPACE)
    starts = np.flatnonzero(start)
    if joins_space:
        return starts, np.append(starts[1:], n)
    stop = np.append(start | (kind == SPACE), True)
    stop[:n] |= opens[:n]
    stops = np.flatnonzero(stop)
    return starts, stops[np.searchsorted(stops, starts, side="right")]


def split(texts: list[str], joins_space: bool) -> Pieces:
    """The pieces of all texts; none for an empty text."""
    joined = "".join(texts)
    points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    begins = np.cumsum(sizes) - sizes
    if not len(points):
        none = np.zeros(0, np.int64)
        return Pieces(none, none, none.astype(np.uint64), "", none.reshape(0, 2))
    return pieces_at(joined, points, *_starts(points, begins[sizes > 0], joins_space), sizes)


def pieces_at(joined: str, points: np.ndarray, starts: np.ndarray, ends: np.ndarray, sizes: np.ndarray) -> Pieces:
    """The pieces with these starts and ends in texts of these sizes, end to end."""
    hashes = span_hashes(symbol_values()[points], starts, ends)
    code, distinct = pd.factorize(hashes)
    first = np.zeros(len(distinct), np.int64)
    first[code[::-1]] = np.arange(len(code))[::-1]
    edges = np.searchsorted(starts, np.concatenate([[0], np.cumsum(sizes)]))
    owner = np.repeat(np.arange(len(sizes)), np.diff(edges))
    return Pieces(owner, code, distinct, joined, np.stack([starts[first], ends[first]], 1))


def blocks(texts: list[str], most: int = 1 << 18):
    """(from, to) of runs of texts with about ``most`` characters; a longer text is a run of its own."""
    begin = total = 0
    for i, t in enumerate(texts):
        if total and total + len(t) > most:
            yield begin, i
            begin, total = i, 0
        total += len(t)
    if begin < len(texts):
        yield begin, len(texts)


def long_parts(text: str, most: int) -> Iterator[str]:
    """The text in parts of about ``most`` characters, cut before a blank that stands between two characters that are
    no white space: no pre-token spans such a gap. A text without one is one part."""
    at = 0
    while at < len(text):
        cut = text.find(" ", at + most)
        while 0 <= cut < len(text) - 1 and (text[cut - 1].isspace() or text[cut + 1].isspace()):
            cut = text.find(" ", cut + 1)
        if not 0 <= cut < len(text) - 1:
            cut = len(text)
        yield text[at:cut]
        at = cut


def part_blocks(texts: Iterable[str], most: int = 1 << 18) -> Iterator[tuple[list[int], list[str]]]:
    """Parts of texts in blocks of about ``most`` characters, and the number of the text that each part is of. Parts of
    a text follow each other; empty texts have none."""
    rows: list[int] = []
    found: list[str] = []
    size = 0
    for k, text in enumerate(texts):
        for part in long_parts(text, most):
            rows.append(k)
            found.append(part)
            size += len(part)
            if size >= most:
                yield rows, found
                rows, found, size = [], [], 0
    if found:
        yield rows, found


def cut_specials(texts: list[str], specials: tuple[str, ...]) -> tuple[list[str], np.ndarray, dict[int, str]]:
    """Texts cut at special strings: the parts, the text that each part is of, and by part the special string after it."""
    if not any(s in t for t in texts for s in specials):
        return texts, np.arange(len(texts)), {}
    pattern = re.compile("(" + "|".join(map(re.escape, specials)) + ")")
    parts, owner, after = [], [], {}
    for i, t in enumerate(texts):
        for k, x in enumerate(pattern.split(t)):
            if k % 2:
                after[len(parts) - 1] = x
            else:
                parts.append(x)
                owner.append(i)
    return parts, np.array(owner), after


def ragged(offsets: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indexes offset, offset + 1 … for each length, end to end."""
    total = np.cumsum(lengths)
    n = int(total[-1]) if len(total) else 0
    return np.arange(n) + np.repeat(offsets - (total - lengths), lengths)


def encoded_words(tokenizer: Tokenizer, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All ids of the words end to end, and the number of each word's, by one call of the library."""
    found = tokenizer.encode(words, is_pretokenized=True, add_special_tokens=False)
    return np.array(found.ids, np.uint32), np.bincount(np.array(found.word_ids, np.int64), minlength=len(words))


class WordIds:
    """Ids of distinct pieces, kept from batch to batch up to a bound. encode: ids of each of a list of pieces, as
    lists or as ``encoded_words`` gives them."""

    def __init__(self, encode, most: int = 1 << 18):
        self.encode, self.most = encode, most
        self.clear()

    def clear(self) -> None:
        self.keys, self.slots = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # by key
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0
        self.begin = np.zeros(1 << 12, np.int64)
        self.length = np.zeros(1 << 12, np.int64)

    def of(self, pieces: Pieces) -> np.ndarray:
        """The slot of each distinct piece."""
        keys = pieces.hashes
        if len(self.keys) + len(keys) > self.most:
            self.clear()
        at = np.searchsorted(self.keys, keys)
        there = (np.append(self.keys, np.uint64(0))[at] == keys) & (at < len(self.keys))
        found = np.append(self.slots, 0)[at]
        new = np.flatnonzero(~there)
        if len(new):
            new = new[np.argsort(keys[new])]
            found[new] = len(self.keys) + np.arange(len(new))
            self._add(len(self.keys), self.encode(pieces.words(new)))
            self.keys = np.insert(self.keys, at[new], keys[new])
            self.slots = np.insert(self.slots, at[new], found[new])
        return found

    def _add(self, at: int, ids: list[list[int]] | tuple[np.ndarray, np.ndarray]) -> None:
        if isinstance(ids, tuple):
            flat, lengths = ids
        else:
            lengths = np.fromiter(map(len, ids), np.int64, len(ids))
            flat = np.fromiter((x for y in ids for x in y), np.uint32, int(lengths.sum()))
        while len(self.ids) < self.used + len(flat):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while len(self.begin) < at + len(lengths):
            self.begin, self.length = (np.concatenate([x, np.zeros_like(x)]) for x in (self.begin, self.length))
        self.ids[self.used : self.used + len(flat)] = flat
        self.length[at : at + len(lengths)] = lengths
        self.begin[at : at + len(lengths)] = self.used + np.cumsum(lengths) - lengths
        self.used += len(flat)


def encoded(texts: list[str], cache: WordIds, joins_space: bool, specials: dict[str, int], clean=lambda t: t) -> tuple[np.ndarray, np.ndarray]:
    """All ids of the texts end to end, and the number of each text's. specials: strings with an id of their own.
    clean: what is done to a text between special strings before it is split."""
    parts, owner, after = cut_specials(texts, tuple(specials))
    pieces = split([clean(t) for t in parts], joins_space)
    slots = cache.of(pieces)[pieces.code] if len(pieces.code) else pieces.code
    begin, length, text = cache.begin[slots], cache.length[slots], pieces.text
    ids = cache.ids[: cache.used]
    if after:
        names = sorted(specials)
        at = np.array(list(after))
        put = np.searchsorted(text, at, side="right")
        begin = np.insert(begin, put, [len(ids) + names.index(s) for s in after.values()])
        length, text = np.insert(length, put, 1), np.insert(text, put, at)
        ids = np.concatenate([ids, np.array([specials[s] for s in names], np.uint32)])
    sizes = np.bincount(owner[text], weights=length, minlength=len(texts)).astype(np.int64) if len(text) else np.zeros(len(texts), np.int64)
    return ids[ragged(begin, length)], sizes


def encoded_whole(texts: list[str], cache: WordIds, joins_space: bool, specials: dict[str, int], clean=lambda t: t) -> tuple[np.ndarray, np.ndarray]:
    """As ``encoded``, a block of parts at a time: what is held besides the ids does not grow with a text."""
    found, sizes = [np.zeros(0, np.uint32)], np.zeros(len(texts), np.int64)
    for rows, parts in part_blocks(texts):
        ids, lengths = encoded(parts, cache, joins_space, specials, clean)
        found.append(ids)
        np.add.at(sizes, rows, lengths)
    return np.concatenate(found), sizes
