import hashlib
import random

import numpy as np
import pytest
from public_tokenizers import path
from tokenizers import Tokenizer

from loomspark.llm import bpe_trie, pretoken
from loomspark.llm.common import read
from loomspark.llm.token_counts import token_counts
from tests.llm.conftest import AWKWARD, rows_of

BYTES, WORDS = (Tokenizer.from_file(path(n)) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
ALPHABET = ["'", "s", "t", "re", "ve", "ll", "d", "m", " ", " ", "\n", "\t", "a", "é", "B", "1", "²", "!", ".", "漢", " ", "Σ", "İ", "́", "\x1c", "<|", "😀", "<|endoftext|>", "aa"]


def random_texts(n, seed=5):
    r = random.Random(seed)
    return ["".join(r.choice(ALPHABET) for _ in range(r.randint(0, 14))) for _ in range(n)]


@pytest.mark.parametrize(("joins", "tokenizer"), [(True, BYTES), (False, WORDS)])
def test_split_is_the_library_s(joins, tokenizer):
    texts = random_texts(4000)
    found = pretoken.split(texts, joins)
    words, got = found.words(), [[] for _ in texts]
    for t, c in zip(found.text, found.code):
        got[t].append(words[c])
    assert got == [[t[a:b] for _, (a, b) in tokenizer.pre_tokenizer.pre_tokenize_str(t)] for t in texts]


def test_trie_encodes_as_the_library():
    _, specials, cache, table = bpe_trie.loaded(bpe_trie.TOKENIZER)
    texts = random_texts(4000, 6) + ["ab" * 3000]
    ids, sizes = pretoken.encoded(texts, cache, False, specials, bpe_trie.cleaned)
    got = [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])]
    assert got == [e.ids for e in WORDS.encode_batch(texts, add_special_tokens=False)]
    assert [" ".join(table[x]) for x in got] == WORDS.decode_batch(got, skip_special_tokens=False)


def expected_counts(rows):
    return sorted(((i, len((t or "").encode()), n := len(BYTES.encode(t or "", add_special_tokens=False).ids), n > 512) for i, t in rows), key=repr)


@pytest.mark.parametrize("head", [0, 20, 1 << 18])
def test_token_counts(awkward, head):
    assert rows_of(token_counts(awkward, head=head)) == expected_counts(AWKWARD)


def expected_digests(rows):
    out = []
    for i, t in rows:
        ids = WORDS.encode(t or "", add_special_tokens=False).ids
        decoded = WORDS.decode(ids, skip_special_tokens=False)
        out.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    return sorted(out, key=repr)


def test_encoding_digests(awkward):
    assert rows_of(bpe_trie.encoding_digests(awkward)) == expected_digests(AWKWARD)


def test_on_documents(spark):
    docs = read(spark, "/root/testdata/sf0.001", "documents")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert rows_of(token_counts(docs)) == expected_counts(rows)
    assert rows_of(bpe_trie.encoding_digests(docs)) == expected_digests(rows)


def test_no_rows(no_rows):
    assert token_counts(no_rows).collect() == [] == bpe_trie.encoding_digests(no_rows).collect()
