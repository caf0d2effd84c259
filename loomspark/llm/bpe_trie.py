"""BPE encoding by a trie of distinct words, and decoding.

A prefix of a word has one valid encoding; its last token, with the last tokens of shorter prefixes, gives the
whole. Words of a batch are put into a trie, and a depth-first walk finds the last token of each node from those
of its ancestors: the one token that ends there and can stand after the last token where it begins. What words
share is therefore worked out once. The trie is held in preorder: its words sorted, and for each the depth at which
its branch leaves that of the word before; the walk holds the states of one branch, so that a very long word takes a
few bytes a letter.
"""

from __future__ import annotations

import json
import os
import unicodedata
from array import array
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.llm import pretoken
from loomspark.llm.common import arrow, id_and_text, sliced

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
NEVER = 1 << 60
#: Pairs of tokens of which a worker remembers whether they can stand side by side.
KNOWN = 1 << 18


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {b: chr(b) for b in plain}
    for k, b in enumerate(b for b in range(256) if b not in letters):
        letters[b] = chr(256 + k)
    return [letters[b] for b in range(256)]


class Merges:
    """Which tokens a byte-pair vocabulary lets stand side by side."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], end: str):
        self.end, self.names = end, {i: t for t, i in vocab.items()}
        self.rank: dict[tuple[int, int], int] = {}
        self.made: dict[int, tuple[int, int, int]] = {}
        for r, (a, b) in enumerate(merges):
            pair = vocab[a], vocab[b]
            self.rank.setdefault(pair, r)
            self.made.setdefault(vocab[a + b], (*pair, r))
        self.inner = {t: i for t, i in vocab.items() if not t.endswith(end)}
        self.final = {t.removesuffix(end): i for t, i in vocab.items() if t.endswith(end)}
        self.longest = max(map(len, vocab))
        self.fits: dict[tuple[int, int], bool] = {}
        self.whole: dict[int, bool] = {}

    def _apart(self, left: int, right: int, before: int) -> bool:
        """Whether no merge of a rank below ``before`` joins the two across their border.

        From either token the parts at the border are followed back through the merges that made it. A merge of
        two parts that meet happens if neither is used up sooner; of equal merges, that further left comes first.
        """
        lefts, a, until = [], left, before
        while True:
            lefts.append((a, until))
            if a not in self.made:
                break
            _, a, until = self.made[a]
        b, until_b = right, before
        while True:
            for a, until_a in lefts:
                rank = self.rank.get((a, b))
                if rank is not None and rank < before and rank < until_a and rank <= until_b:
                    return False
            if b not in self.made:
                return True
            b, _, until_b = self.made[b]

    def alone(self, token: int) -> bool:
        """Whether the token's own string is encoded as the token."""
        if (known := self.whole.get(token)) is None:
            made = self.made.get(token)
            known = self.whole[token] = made is None or self.alone(made[0]) and self.alone(made[1]) and self._apart(*made)
        return known

    def beside(self, left: int, right: int) -> bool:
        """Whether the two tokens' joined string is encoded as the two."""
        if (known := self.fits.get((left, right))) is None:
            if len(self.fits) > KNOWN:
                self.fits.clear()
            known = self.fits[left, right] = self.alone(right) and self._apart(left, right, NEVER)
        return known

    def last(self, tail: str, depth: int, lasts: array, vocab: dict[str, int]) -> tuple[int, int]:
        """The last token of a prefix's encoding and its length. tail: as many of the prefix's letters as a token can
        have; depth: the prefix's length; lasts[n]: the last token of its first n letters."""
        begin = depth - len(tail)
        for k in range(len(tail)):
            token = vocab.get(tail[k:])
            if token is not None and (self.beside(lasts[begin + k], token) if begin + k else self.alone(token)):
                return token, len(tail) - k
        raise ValueError(f"no token ends {tail!r}")

    def encode(self, words: list[str]) -> list[list[int]]:
        """The ids of each word, a string of byte letters. The trie holds all letters but a word's last, which the
        vocabulary spells in another way."""
        out: list[list[int]] = [[]] * len(words)
        lasts, sizes = array("i", [0]), array("i", [0])  # by depth, on the branch
        branch = ""
        for w in sorted(range(len(words)), key=words.__getitem__):
            word = words[w]
            leaves = len(os.path.commonprefix([branch, word[:-1]]))
            branch = word[:-1]
            del lasts[leaves + 1 :], sizes[leaves + 1 :]
            for depth in range(leaves + 1, len(word)):
                token, size = self.last(word[max(0, depth - self.longest) : depth], depth, lasts, self.inner)
                lasts.append(token)
                sizes.append(size)
            token, size = self.last(word[-self.longest :], len(word), lasts, self.final)
            ids, at = [token], len(word) - size
            while at:
                ids.append(lasts[at])
                at -= sizes[at]
            out[w] = ids[::-1]
        return out


@cache
def loaded(path: str) -> tuple[Merges, dict[str, int], pretoken.WordIds, np.ndarray]:
    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    model = data["model"]
    merges = Merges(model["vocab"], [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]], model["end_of_word_suffix"])
    letters = byte_letters()
    specials = {t["content"]: t["id"] for t in data["added_tokens"]}
    names = merges.names | {i: t for t, i in specials.items()}
    table = np.array([names.get(i, "") for i in range(max(names) + 1)], object)
    spelt = lambda word: "".join(letters[b] for b in word.encode())
    return merges, specials, pretoken.WordIds(lambda words: merges.encode([spelt(w) for w in words])), table


def cleaned(text: str) -> str:
    """As the file's normaliser; white space is dropped later, whatever its kind."""
    if not text.isascii():
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # which Python lower-cases by what is around it
    return text.lower()


ENCODED = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("decoded", pa.string())])


def encode_documents(docs: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit integers), decoded: one row for each row of ``docs``.

    The ids are the library's without tokens added at the ends; special strings inside a text are one token each.
    decoded: the tokens joined by a blank each, as the library decodes a vocabulary without a decoder. Null text
    counts as empty: no ids, an empty string. Repeated rows and null ids stay; other columns are ignored.
    Long texts are encoded in parts cut between words. No row leaves its partition: every task has the trie of its own
    words. No rows: no rows.
    """

    def encode(batches):
        _, specials, words, table = loaded(path)
        for batch in sliced(batches):
            ids, sizes = pretoken.encoded_whole(batch.column(1).to_pylist(), words, False, specials, cleaned)
            ends = np.cumsum(sizes)
            spans = list(zip((ends - sizes).tolist(), ends.tolist()))
            yield arrow({"doc_id": batch.column(0), "n_tokens": sizes, "ids": [ids[i:j].astype("<u4").tobytes() for i, j in spans], "decoded": [" ".join(table[ids[i:j]]) for i, j in spans]}, ENCODED)

    docs = id_and_text(docs).select(F.col("doc_id").cast("long"), "text")
    return docs.mapInArrow(encode, "doc_id long, n_tokens long, ids binary, decoded string")


def encoding_digests(docs: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """doc_id, n_tokens, and SHA-256 digests of the ids and of the decoded text."""
    return encode_documents(docs, path).select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
