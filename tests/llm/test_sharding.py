import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from loomspark.llm import sharding
from loomspark.llm.common import read
from tests.llm.conftest import AWKWARD


def check(rows, got, shards=8):
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in got), key=repr) == sorted(((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows), key=repr)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < shards
    assert all(sorted(s) == [*range(len(s))] for s in slots.values())


def test_documents(spark):
    docs = read(spark, "/root/testdata/sf0.1", "documents")
    got = sharding.shard_documents(docs).collect()
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    check(rows, got)
    sizes, shard = Counter(), {}
    for r in got:
        sizes[r.shard] += r.size
        shard[r.doc_id] = r.shard
    assert max(sizes.values()) - min(sizes.values()) < 0.001 * sum(sizes.values())
    rows_of_shard, words = Counter(shard.values()), Counter()
    for i, t in rows:
        words[shard[i]] += (t or "").count(" ") + 1
    for found in (sizes, rows_of_shard, words):  # within five thousandths of a shard
        assert max(found.values()) - min(found.values()) < 0.005 / 8 * sum(found.values()) + 1
    by_text = defaultdict(set)
    for i, t in rows:
        by_text[t].add(shard[i])
    assert all(len(x) == 1 for x in by_text.values())


def test_awkward(awkward, no_rows):
    check(AWKWARD, sharding.shard_documents(awkward).collect())
    assert sharding.shard_documents(no_rows).collect() == []


def test_hot_group_is_split(spark):
    rows = [(i, "same text " * 20 if i % 3 == 0 else f"text {i} " * 20) for i in range(6000)]
    got = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    check(rows, got)
    sizes = Counter()
    for r in got:
        sizes[r.shard] += r.size
    assert max(sizes.values()) < 1.02 * min(sizes.values())


def test_groups_that_fit_a_shard_stay_whole_and_shards_are_even_in_all_three(spark):
    rows = [(i, "same text of many words " * 9 if i % 10 == 0 else f"text {i} " * (1 + i % 40)) for i in range(9000)]
    got = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    check(rows, got)
    text, sums = dict(rows), defaultdict(lambda: np.zeros(3))
    for r in got:
        sums[r.shard] += [r.size, text[r.doc_id].count(" ") + 1, 1]
    assert len({r.shard for r in got if r.doc_id % 10 == 0}) == 1
    full = np.array(list(sums.values()))
    assert (full.max(0) - full.min(0) < np.array([0.005, 0.05, 0.2]) * full.mean(0)).all()


@pytest.mark.parametrize("seed", range(3))
def test_placing_by_the_definition(seed):
    r = np.random.default_rng(seed)
    sizes = r.pareto(1.5, (300, 3)) + 0.01
    sizes /= sizes.sum(0)
    room, want = [[1 / 8] * 3 for _ in range(8)], {}
    for i in sorted(range(300), key=lambda i: (-sizes[i][0], i)):
        dot = [sum(w * s * x for w, s, x in zip(sharding.WEIGHTS, sizes[i], room[k])) for k in range(8)]
        fits = [k for k in range(8) if all(x >= s - 1e-12 for x, s in zip(room[k], sizes[i]))] or range(8)
        want[i] = k = max(fits, key=lambda k: (dot[k], -k))
        room[k] = [x - s for x, s in zip(room[k], sizes[i])]
    assert sharding.placed(sizes, 8).tolist() == [want[i] for i in range(300)]


@pytest.mark.parametrize("seed", range(3))
def test_placing(seed):
    r = np.random.default_rng(seed)
    sizes = r.pareto(2, (5000, 3)) + 0.1
    sizes /= sizes.sum(0)
    full = np.zeros((8, 3))
    np.add.at(full, sharding.placed(sizes, 8), sizes)
    assert full[:, 0].max() - full[:, 0].min() < 0.002
    assert full.max() < 0.15
