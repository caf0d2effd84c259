import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomspark.llm import suffix_dedup as sd
from loomspark.llm.common import read
from tests.llm.conftest import AWKWARD, rows_of


def expected(rows, length=sd.LENGTH):
    """By a table of all strings."""
    texts = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(t[k : k + length] for _, t in texts for k in range(len(t) - length + 1))
    out = []
    for i, t in texts:
        gone = bytearray(len(t))
        for k in range(len(t) - length + 1):
            if seen[t[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        kept = bytes(c for c, g in zip(t, gone) if not g)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


def test_documents(spark):
    docs = read(spark, "/root/testdata/sf0.001", "documents")
    assert rows_of(sd.removal_digests(docs)) == expected([tuple(r) for r in docs.select("doc_id", "text").collect()])


def random_rows(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdé ") for _ in range(r.randint(1, 9)))
    passages = ["".join(word() for _ in range(r.randint(20, 120))) for _ in range(12)]
    rows = []
    for i in range(150):
        parts = [r.choice(passages)[r.randint(0, 60) :][: r.randint(100, 500)] if r.random() < 0.5 else "".join(word() for _ in range(r.randint(1, 60))) for _ in range(r.randint(0, 6))]
        rows.append((i, "".join(parts)))
    return [*rows, (500, "ab" * 400), (501, "a" * 199), (502, "b" * 200), (503, "b" * 200), (504, "c" * 201), (505, "é" * 150)]


@pytest.mark.parametrize("seed", range(2))
def test_random(spark, seed):
    rows = random_rows(seed)
    assert rows_of(sd.removal_digests(frame(spark, rows))) == expected(rows)


def test_small_blocks_and_hot_buckets(spark, monkeypatch):
    """Texts that come in pieces, buckets dealt by strings, and salted grams give the same rows."""
    rows = random_rows(9)
    rows += [(600, "".join(t for _, t in rows)), (601, rows[3][1] + "".join(t for _, t in rows[:40]))]
    batch = pa.RecordBatch.from_pydict({"a": [1], "b": [2], "text": [rows[-1][1]]})
    monkeypatch.setattr(sd, "BLOCK", 700)
    data = rows[-1][1].encode()
    every = lambda x: np.ones(len(x), bool)
    runs = [x for b in sd.find_runs(iter([batch]), every, np.zeros(0, np.int64)) for x in b.to_pylist()]
    assert sorted({s for x in runs for s in range(x["lo"], x["hi"] + 1)}) == [*range(len(data) - sd.LENGTH + 1)]
    monkeypatch.setattr(sd, "HOT", 2)
    assert rows_of(removal_digests_of(spark, rows)) == expected(rows)


def test_a_text_of_many_blocks(spark):
    r = random.Random(5)
    long = "".join(r.choice("abcdefghijklmnop ") for _ in range(sd.BLOCK + 50_000))
    rows = [(1, long), (2, "x" * 300 + long[sd.BLOCK - 700 : sd.BLOCK + 700]), (3, long[: sd.BLOCK - 100][-450:])]
    assert rows_of(removal_digests_of(spark, rows)) == expected(rows)


def removal_digests_of(spark, rows):
    return sd.removal_digests(frame(spark, rows))


def test_common_passage_in_unlike_texts(spark):
    r = random.Random(3)
    word = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    passage, other = word(260), word(230)
    rows = [(i, word(r.randint(0, 90)) + (passage if i % 3 else other + passage[:190]) + word(r.randint(0, 90))) for i in range(240)]
    rows += [(i, "the same text of many rows " * 12) for i in [1000] * 40 + [None] * 40]
    assert rows_of(removal_digests_of(spark, rows)) == expected(rows)


def test_equal_members_beyond_a_block(monkeypatch):
    """A bucket that goes on through many batches, nearly all of one document: other members are still found."""
    monkeypatch.setattr(sd, "HOT", 4)
    around = bytes(range(100))
    row = {"a": 1, "b": 1, "lo": 500, "hi": 549, "bucket": 7, "check": 7, "x0": 0, "x1": 49, "around": around, "whole": False, "mark": False}
    rows = [row] * 60 + [{**row, "a": 2, "around": around[:75] + b"x" * 25}]
    batches = [pa.RecordBatch.from_pylist(rows[k : k + 5], pa.schema([*sd.KEY, *sd.MEMBER])) for k in range(0, len(rows), 5)]
    marks = [x for b in sd.refine_members(iter(batches)) for x in b.to_pylist()]
    assert {s for x in marks if x["a"] == 1 for s in range(x["lo"], x["hi"] + 1)} == {*range(500, 550)}
    assert {s for x in marks if x["a"] == 2 for s in range(x["lo"], x["hi"] + 1)} == {*range(500, 525)}  # 25 … 49 bytes before


def test_removing_the_refined_buckets_changes_the_result(spark, monkeypatch):
    docs = read(spark, "/root/testdata/sf0.001", "documents")
    whole = rows_of(sd.removal_digests(docs))
    monkeypatch.setattr(sd, "refined", lambda rows, name: rows.withColumn("n", F.lit(2)).withColumn("bucket", F.xxhash64("a", "b", "at", "place")).drop("x", "y"))
    assert rows_of(sd.removal_digests(docs)) != whole


def test_awkward(awkward, no_rows):
    assert rows_of(sd.removal_digests(awkward)) == expected(AWKWARD)
    assert sd.removal_digests(no_rows).collect() == []
