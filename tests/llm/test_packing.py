import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from public_tokenizers import path
from tokenizers import Tokenizer

from loomspark.llm.common import read
from loomspark.llm.packing import Piece, Windows, encoded, packed_documents, packing_digests
from tests.llm.conftest import AWKWARD
from tests.llm.test_tokens import random_texts

WORDS = Tokenizer.from_file(path("word_bpe_49k.json"))
TOKENIZER = path("word_bpe_49k.json")


def ids_of(text):
    return [*WORDS.encode(text or "", add_special_tokens=False).ids, 1]


def check(pieces, rows, size=2048):
    """Sequences are gapless and need no padding, and each document's ids are in exactly one piece each."""
    sequences, documents = defaultdict(list), defaultdict(list)
    for p in pieces:
        assert len(p["ids"]) > 0
        sequences[p["sequence_id"]].append((p["offset"], len(p["ids"]) // 4))
        documents[p["doc_id"], p["doc_tokens"]].append((p["start"], np.frombuffer(p["ids"], "<u4").tolist()))
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at == size or (at < size and at & (at - 1) == 0)
    want = Counter((i, tuple(ids_of(t))) for i, t in rows)
    for (doc_id, n), parts in documents.items():
        texts = [t for (i, t), k in want.items() if i == doc_id and len(t) == n for _ in range(k)]
        # of equal sizes: any order of whole documents
        covered = Counter(start + k for start, ids in parts for k in range(len(ids)))
        assert covered == Counter({k: len(texts) for k in range(n)})
        if len(set(texts)) == 1:
            assert all(tuple(ids) == texts[0][start : start + len(ids)] for start, ids in parts)
    assert {(i, len(t)) for i, t in want} == set(documents)


def test_ids_are_the_library_s():
    texts = random_texts(3000, 8) + [" ".join(random_texts(60_000, 2)), "", "long " * 100_000]
    assert [x.tolist() for x in encoded(texts, TOKENIZER, 1)] == [ids_of(t) for t in texts]


@pytest.mark.parametrize("seed", range(4))
def test_each_piece_goes_where_the_sum_of_squares_becomes_least(seed):
    r, size = random.Random(seed), 24
    windows, levels = Windows(size, 1 << 20), Counter()
    for k in range(400):
        n = r.choice([r.randint(1, size), 5, 7])
        sums = {}
        for level in [0, *levels]:
            if level + n <= size:
                after = levels.copy()
                if level:
                    after[level] -= 1
                if level + n < size:
                    after[level + n] += 1
                sums[level] = sum(x * x for x in after.values())
        least = max(level for level, x in sums.items() if x == min(sums.values()))
        assert windows.level(n) == least
        full = list(windows.add(Piece(k, 0, np.arange(n, dtype=np.uint32), n)))
        assert len(full) == (least + n == size)
        if least:
            levels[least] -= 1
        if least + n < size:
            levels[least + n] += 1
        levels = +levels
        assert {h: len(w) for h, w in enumerate(windows.at) if w} == levels


@pytest.mark.parametrize(("size", "most"), [(16, 3), (16, 1 << 12), (64, 5)])
def test_windows_that_are_left_fill_each_other(size, most):
    r, out, total = random.Random(size), [], 0
    windows = Windows(size, most)
    for k in range(300):
        n = r.choice([size * 3 // 4, size * 3 // 4, r.randint(1, size)])
        total += n
        out += windows.add(Piece(k, 0, np.full(n, k, np.uint32), n))
        assert windows.n <= max(most, 1)
    assert all(sum(len(p.ids) for p in w) == size for w in out)
    last = list(windows.end())
    lengths = [sum(len(p.ids) for p in w) for w in last]
    assert sum(x < size for x in lengths) <= size.bit_length() and all(x & (x - 1) == 0 for x in lengths)
    ids = Counter(i for w in [*out, *last] for p in w for i in p.ids.tolist())
    assert sum(ids.values()) == total


@pytest.mark.parametrize("size", [2048, 32])
def test_awkward_rows(awkward, size):
    check([r.asDict() for r in packed_documents(awkward, size=size, most=2).collect()], AWKWARD, size)


def test_documents(spark):
    docs = read(spark, "/root/testdata/sf0.001", "documents")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    pieces = packed_documents(docs)
    found = [r.asDict() for r in pieces.collect()]
    check(found, rows)
    digests = packing_digests(docs).collect()
    assert sorted((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens, r.sequence_id, r.offset) for r in digests) == sorted(
        (p["doc_id"], p["start"], len(p["ids"]) // 4, zlib.crc32(p["ids"]), p["doc_tokens"], p["sequence_id"], p["offset"]) for p in found
    )
    # the greater part of the documents that fit a window is whole
    whole = Counter(p["doc_id"] for p in found if p["doc_tokens"] <= 2048)
    assert sum(n == 1 for n in whole.values()) > 0.8 * len(whole)


def test_no_rows(no_rows):
    assert packed_documents(no_rows).collect() == []
