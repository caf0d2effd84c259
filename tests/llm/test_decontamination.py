import random
import re

import numpy as np
import pytest

from loomspark.llm import decontamination as dc
from loomspark.llm.common import read
from tests.llm.conftest import AWKWARD

WORD = re.compile(r"[^\W_]+")


def expected(docs, items):
    """The most similar window of each document and item, over all windows; a shorter document is one."""
    out = {}
    for i, item in items:
        a = WORD.findall((item or "").lower())
        w = min(5, len(a))
        if not w:
            continue
        counts = dc.shingle_counts(a, w)
        for k, (d, text) in enumerate(docs):
            b = WORD.findall((text or "").lower())
            if not any(s in counts for s in zip(*(b[j:] for j in range(w)))):
                continue
            best = max((dc.similarity(dc.shingle_counts(b[s : s + len(a)], w), counts) for s in range(max(1, len(b) - len(a) + 1))), default=0)
            if best >= 0.8:
                out[k, i] = (d, i, round(best, 9))
    return sorted(out.values(), key=repr)


def got(df):
    return sorted(((r.doc_id, r.item_id, round(r.similarity, 9)) for r in df.collect()), key=repr)


def test_documents(spark):
    docs, items = (read(spark, "/root/testdata/sf0.01", t) for t in ("documents", "benchmark"))
    want = expected([tuple(r) for r in docs.select("doc_id", "text").collect()], [tuple(r) for r in items.collect()])
    assert want and got(dc.contaminated(docs, items)) == want
    assert got(dc.contaminated(docs, items, block_bytes=2000)) == want
    bad = {d for d, *_ in want}
    kept = dc.without_benchmark(docs, items)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.select("doc_id").collect()} == {r.doc_id for r in docs.select("doc_id").collect()} - bad


def test_edited_passages(spark):
    r = random.Random(4)
    vocabulary = [f"w{i}" for i in range(500)]
    items = [(i, " ".join(r.choice(vocabulary) for _ in range(r.randint(1, 60)))) for i in range(60)] + [(100, None), (101, ""), (102, "one two"), (103, "rep " * 30)]
    docs = []
    for k in range(300):
        words = [r.choice(vocabulary) for _ in range(r.randint(0, 80))]
        passage = (r.choice(items)[1] or "").split()
        for _ in range(r.choice([0, 0, 1, 1, 2, 3])):
            if passage:
                j = r.randrange(len(passage))
                passage[j : j + r.randint(0, 1)] = [r.choice(vocabulary)] * r.randint(0, 1)
        at = r.randint(0, len(words))
        docs.append((k, " ".join(words[:at] + passage + words[at:])))
    docs += [(900, "rep " * 25), (901, "one, TWO!"), (902, "x rep " * 3 + "rep " * 400)]
    frame = lambda rows, name: spark.createDataFrame(rows, f"{name} long, text string")
    assert got(dc.contaminated(frame(docs, "doc_id"), frame(items, "item_id"))) == expected(docs, items)


@pytest.mark.parametrize("items", [[], [(1, "the cat sat on the mat"), (None, "no id at all"), (5, None)]])
def test_awkward(spark, awkward, no_rows, items):
    table = spark.createDataFrame(items, "item_id long, text string")
    assert got(dc.contaminated(awkward, table)) == expected(AWKWARD, items)
    assert dc.contaminated(no_rows, table).collect() == []
    kept = dc.without_benchmark(awkward, table)
    assert kept.columns == awkward.columns
    assert kept.count() == len(AWKWARD) - len({k for k, (d, t) in enumerate(AWKWARD) if expected([(d, t)], items)})


def test_blocks_find_all_within_the_radius():
    r = random.Random(1)
    fps = [(i, r.getrandbits(64)) for i in range(300)]
    index = dc.HammingBlocks(fps, 24)
    for _ in range(50):
        q = r.choice(fps)[1]
        for _ in range(r.randint(0, 30)):
            q ^= 1 << r.randrange(64)
        assert index.near(q) == [i for i, f in fps if (f ^ q).bit_count() <= 24]


def test_documents_shorter_than_an_item(spark):
    words = [f"w{k}" for k in range(30)]
    docs = [(1, " ".join(words[:28])), (2, " ".join(words[:20])), (3, " ".join(words[:4])), (4, " ".join(words[1:29] + ["x"] * 4))]
    items = [(7, " ".join(words))]
    found = got(dc.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")))
    assert found == expected(docs, items) and [d for d, *_ in found] == [1, 4]


@pytest.mark.parametrize("size", [1, 7, 40])
def test_rolling_fingerprints(size):
    hashes = np.random.default_rng(size).integers(0, 1 << 63, 90, np.uint64) * np.uint64(2) + np.uint64(1)
    one = [sum(1 << b for b in range(64) if 2 * sum(int(h) >> b & 1 for h in hashes[k : k + size]) > size) for k in range(len(hashes) - size + 1)]
    assert dc.window_fingerprints(hashes, size).tolist() == one


def test_candidates_come_from_the_index(spark, monkeypatch):
    """An index that gives nothing leaves no match; texts without their own windows find what the index gives."""
    docs = [r.text for r in read(spark, "/root/testdata/sf0.01", "documents").collect()]
    items = [tuple(r) for r in read(spark, "/root/testdata/sf0.01", "benchmark").collect()]
    assert list(dc.Benchmark(items).matches(docs))
    monkeypatch.setattr(dc.HammingBlocks, "pairs", lambda self, f: (np.zeros(0, np.int64), np.zeros(0, np.int64)))
    assert not list(dc.Benchmark(items).matches(docs))
