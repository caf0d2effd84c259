import zlib

import numpy as np
import pyarrow as pa
import pytest
from public_tokenizers import path
from tokenizers import Tokenizer

from loomspark.llm import token_files as tf
from loomspark.llm.common import read
from tests.llm.conftest import AWKWARD, rows_of

BYTES = Tokenizer.from_file(path("byte_bpe_50k.json"))


@pytest.mark.parametrize("bits", [1, 3, 8, 11, 15, 16, 17, 20, 31])
def test_pack_round_trip(bits):
    r = np.random.default_rng(bits)
    for n in (0, 1, 7, 8, 9, 1000):
        ids = r.integers(0, 1 << bits, n).astype(np.uint32)
        data = tf.pack(ids, bits)
        assert len(data) == -(-n * bits // 8)
        assert (tf.unpack(data, n, bits) == ids).all()


def test_random_access(tmp_path):
    r = np.random.default_rng(1)
    docs = [r.integers(0, 50257, n).astype(np.uint32) for n in (1, 5, 200_000, 3, 70_000)]
    w = tf.Writer(pa.OSFile(str(tmp_path / "f"), "wb"), tf.bits_for(50257))
    for k, d in enumerate(docs):
        w.add([k], d, np.array([len(d)]))
    w.close()
    reader = tf.Reader(pa.OSFile(str(tmp_path / "f")))
    for k in (4, 0, 2, 1, 3):
        assert (reader.document(k) == docs[k]).all()
    assert [x for a, b in reader.runs(1000) for x in range(a, b)] == [*range(5)]


def expected(rows):
    start, out = 0, []
    for i, t in sorted(((i, t or "") for i, t in rows), key=lambda x: (x[0] is not None, x[0] or 0)):
        ids = np.array([*BYTES.encode(t, add_special_tokens=False).ids, 0], "<u4")
        out.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return sorted(out, key=repr)


def test_files_of_documents(spark):
    docs = read(spark, "/root/testdata/sf0.001", "documents")
    assert rows_of(tf.token_file_digests(docs)) == expected([(r.doc_id, r.text) for r in docs.collect()])


def test_awkward(awkward, no_rows):
    got, want = rows_of(tf.token_file_digests(awkward)), expected(AWKWARD)
    assert [(i, n, c) for i, _, n, c in got if i not in (1, None)] == [(i, n, c) for i, _, n, c in want if i not in (1, None)]
    assert sorted((n, c) for _, _, n, c in got) == sorted((n, c) for _, _, n, c in want)
    spans = sorted((s, n) for _, s, n, _ in got)
    assert all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:])) and spans[0][0] == 0
    assert tf.token_file_digests(no_rows).collect() == []
