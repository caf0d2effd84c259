import random

import numpy as np
import pytest
import xxhash

from loomspark.llm import simhash
from loomspark.llm.common import read
from loomspark.llm.components import connected_components
from tests.llm.conftest import AWKWARD, rows_of


def fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words, word = [], ""
    for c in low + " ":
        if c in " \t\n\x0b\x0c\r":
            words += [word] if word else []
            word = ""
        else:
            word += c
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(pairs):
    root = {a: a for p in pairs for a in p}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {x: find(x) for x in root}


def expected(fps):
    """By comparing all fingerprints with all."""
    distinct = np.array(sorted({f for _, f in fps}), np.uint64)
    near = [(int(distinct[i]), int(f)) for i in range(len(distinct)) for f in distinct[np.bitwise_count(distinct ^ distinct[i]) <= 4]]
    root, least = components(near), {}
    for i, f in fps:
        if i is not None:
            least[root[f]] = min(least.get(root[f], i), i)
    return sorted(((i, f"{f:016x}", least.get(root[f])) for i, f in fps), key=repr)


def test_documents(spark):
    docs = read(spark, "/root/testdata/sf0.01", "documents")
    assert rows_of(simhash.near_duplicates(docs)) == expected([(r.doc_id, fingerprint(r.text)) for r in docs.collect()])


def test_awkward(awkward, no_rows):
    assert rows_of(simhash.near_duplicates(awkward)) == expected([(i, fingerprint(t or "")) for i, t in AWKWARD])
    assert simhash.near_duplicates(no_rows).collect() == []


def clustered(seed, n, clusters=6):
    r = random.Random(seed)
    out = set()
    for _ in range(clusters):
        f = r.getrandbits(64)
        for _ in range(n):
            g = f
            for _ in range(r.randint(0, 3)):
                g ^= 1 << r.randrange(64)
            out.add(g)
            f = g if r.random() < 0.2 else f
    return sorted(out | {r.getrandbits(64) for _ in range(200)})


@pytest.mark.parametrize("hot", [8, 1 << 14])
def test_links_connect_all_within_the_radius(spark, hot):
    fps = clustered(3, 60)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(s,) for s in signed], "fp long")
    got = [(r.a & (1 << 64) - 1, r.b & (1 << 64) - 1) for r in simhash.linked(df, hot=hot).collect()]
    assert all((a ^ b).bit_count() <= 4 for a, b in got)
    array = np.array(fps, np.uint64)
    want = components([(a, int(b)) for a in fps for b in array[np.bitwise_count(array ^ np.uint64(a)) <= 4]])
    assert {frozenset(k for k, v in components(got + [(f, f) for f in fps]).items() if v == x) for x in set(components(got + [(f, f) for f in fps]).values())} == {frozenset(k for k, v in want.items() if v == x) for x in set(want.values())}


def test_plan_covers_the_radius():
    together = np.full((64, 64), 250)
    np.fill_diagonal(together, 500)
    for n in (10, 10_000, 10**8, 10**11):
        plan = simhash.planned(n, together, 4)
        parts = len({b for bits, _ in plan for b in bits})
        assert parts <= 64 and sum(t + 1 for _, t in plan) == 5


def test_components(spark):
    r = random.Random(2)
    pairs = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(200)] + [(5000, 5001 + i) for i in range(300)]
    got = {x.node: x.root for x in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    want = components([p for p in pairs if p[0] != p[1]])
    assert got == want


def test_one_of_each_group(spark, awkward, no_rows):
    docs = read(spark, "/root/testdata/sf0.01", "documents")
    kept = simhash.one_of_each_group(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for *_, c in expected([(r.doc_id, fingerprint(r.text)) for r in docs.collect()])})
    few = simhash.one_of_each_group(awkward)
    assert few.columns == awkward.columns
    assert sorted((r.doc_id, (r.text or "")[:12]) for r in few.collect() if r.doc_id is not None) == [(1, "The cat sat "), (1, "another text"), (2, ""), (5, "naïve café Α"), (6, "special <|en"), (7, "word word wo"), (8, "abcabcabcabc"), (9, "'s 't x's ''")]
    assert simhash.one_of_each_group(no_rows).collect() == []
