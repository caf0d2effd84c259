import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from public_tokenizers import path
from tokenizers import Tokenizer

from loomspark.llm import pretoken
from loomspark.llm.alignment import Aligned, token_alignment
from loomspark.llm.bpe_trie import byte_letters
from loomspark.llm.common import read
from tests.llm.conftest import AWKWARD, rows_of
from tests.llm.test_tokens import random_texts

A = Tokenizer.from_file(path("byte_bpe_50k.json"))
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=path("piece_bpe_32k.model"))
BYTE = {c: b for b, c in enumerate(byte_letters())}
MORE = ["a▁b", "▁", " ", "  ", "x ", " x", "a  b   c", "tail \n", "\x00 nul", "<0x41> <unk> </s>", "blank after blanks    \n\n   x", "🙂🙂 ‍ é"]


def tokens(text):
    """Ids and ends of both sides, or nothing."""
    if not text:
        return [], [], [], []
    whole = (" " + text).encode()
    a, b = A.encode(" " + text, add_special_tokens=False).ids, B.encode(text)
    spelt_a = [bytes(BYTE[c] for c in A.id_to_token(i)) for i in a]
    spelt_b = [bytes([int(B.id_to_piece(i)[1:-1], 16)]) if B.is_byte(i) else B.id_to_piece(i).replace("▁", " ").encode() for i in b]
    if b"".join(spelt_a) != whole or b"".join(spelt_b) != whole:
        return [], [], [], []
    return a, np.cumsum([len(x) for x in spelt_a]).tolist(), b, np.cumsum([len(x) for x in spelt_b]).tolist()


def brute(rows):
    """By the sets of both sides' ends."""
    known, count = [], Counter()
    for doc_id, text in rows:
        a, end_a, b, end_b = tokens(text)
        b_at = dict(zip(end_b, b))
        links = [(x, b_at[e]) for x, e in zip(a, end_a) if e in b_at]
        count.update(links)
        common = np.array(sorted(set(end_a) & set(end_b)))
        groups = [([], []) for _ in common]
        for side, (ids, ends) in enumerate(((a, end_a), (b, end_b))):
            for i, e in zip(ids, ends):
                groups[int(np.searchsorted(common, e))][side].append(str(i))
        spelt = ";".join(",".join(x) + "|" + ",".join(y) for x, y in groups)
        known.append((doc_id, len(a), len(b), len(groups), links, hashlib.sha256(spelt.encode()).hexdigest() if a else ""))
    most = defaultdict(int)
    for (_, y), n in count.items():
        most[y] = max(most[y], n)
    return sorted(((i, n_a, n_b, n, len(links), sum(count[x] == most[x[1]] for x in links), sum(count[x] for x in links), digest) for i, n_a, n_b, n, links, digest in known), key=repr)


@pytest.mark.parametrize("head", [0, 50, 1 << 18])
def test_awkward_texts(spark, awkward, head):
    rows = AWKWARD + [(100 + k, t) for k, t in enumerate(MORE)]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, n_a string, row int").repartition(3)
    assert rows_of(token_alignment(df, head=head)) == brute(rows)


def test_random_texts(spark):
    rows = list(enumerate(random_texts(600, 9) + ["▁".join(random_texts(2, k)) for k in range(20)]))
    assert rows_of(token_alignment(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def test_long_texts_go_in_parts(spark):
    text = " ".join(random_texts(3000, 4))
    assert len(list(pretoken.long_parts(text, 50))) > 100 and "".join(pretoken.long_parts(text, 50)) == text
    rows = [(1, text), (2, "short one"), (3, text + "▁"), (4, text + " "), (5, "x" * 500)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    assert rows_of(token_alignment(df, block=50)) == brute(rows)


def test_documents(spark):
    docs = read(spark, "/root/testdata/sf0.001", "documents")
    assert rows_of(token_alignment(docs)) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_no_rows(no_rows):
    assert token_alignment(no_rows).collect() == []


def test_overlaps_are_all_tokens_that_share_a_byte():
    r = np.random.default_rng(1)
    for _ in range(50):
        end_a, end_b = (np.unique(np.append(r.choice(np.arange(1, 40), r.integers(1, 20)), 40)) for _ in range(2))
        sizes = [np.diff(np.append(0, x)) for x in (end_a, end_b)]
        zero = [np.zeros(len(x), np.int64) for x in sizes]
        found = Aligned.of(1, np.arange(len(end_a)), zero[0], sizes[0], np.arange(len(end_b)), zero[1], sizes[1])
        want = [(i, j) for i in range(len(end_a)) for j in range(len(end_b)) if end_a[i] - sizes[0][i] < end_b[j] and end_b[j] - sizes[1][j] < end_a[i]]
        assert list(zip(*(x.tolist() for x in found.overlaps()))) == want
        assert [(end_a[i], end_b[j]) for i, j in zip(*found.links())] == [(e, e) for e in sorted(set(end_a) & set(end_b))]
