import math
import re
from collections import Counter

import xxhash

from loomspark.llm import quality
from loomspark.llm.common import read
from tests.llm.conftest import AWKWARD

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed


def grams(text):
    tokens = WORD.findall(re.sub(r"([!-/:-@\[-`{-~]+)", r" \1 ", text))
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    first = [xxhash.xxh64_intdigest(t.encode(), 42) for t in tokens]
    second = [xxhash.xxh64_intdigest(t.encode(), h) for h, t in zip(first, tokens[1:])]
    return [signed(h) % quality.BUCKETS for h in first + second]


def expected(rows, trusted):
    raw, target = Counter(), Counter()
    for i, t in rows:
        raw.update(grams(t or ""))
        if i in trusted:
            target.update(grams(t or ""))
    a, n = quality.SMOOTHING, quality.BUCKETS
    base_ratio = math.log(sum(raw.values()) + a * n) - math.log(sum(target.values()) + a * n) if target else 0
    weight = {b: round((math.log((target[b] + a) / (raw[b] + a)) + base_ratio) * quality.UNIT) if target else 0 for b in raw}
    out = []
    for i, t in rows:
        found = base(t or "")
        g = grams(t or "")
        out.append((i, *found, not found[-1] and sum(weight[b] for b in g) >= len(g) * round(quality.THRESHOLD * quality.UNIT)))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r)[:8] for r in df.collect()), key=repr)


def test_documents(spark):
    docs, labels = (read(spark, "/root/testdata/sf0.01", t) for t in ("documents", "labels"))
    trusted = {r.doc_id for r in labels.collect() if r.quality == 1}
    result = quality.quality_rules(docs, labels)
    assert got(result) == expected([(r.doc_id, r.text) for r in docs.collect()], trusted)
    kept = {r.doc_id for r in result.collect() if r.kept}
    bad = {r.doc_id for r in labels.collect() if r.quality == 0}
    clean = {r.doc_id for r in result.collect() if not r.base_failed} & trusted
    assert not kept & bad and clean <= kept


def test_awkward(spark, awkward, no_rows):
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (7, 0, 1), (None, 1, 0), (99, None, None)], "doc_id long, quality int, toxic int")
    assert got(quality.quality_rules(awkward, labels)) == expected(AWKWARD, {1})
    assert quality.quality_rules(no_rows, labels).collect() == []
    assert all(r.kept != r.base_failed for r in quality.quality_rules(awkward, labels.limit(0)).collect())


def test_no_python_in_the_plan(spark, awkward):
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    plan = quality.quality_rules(awkward, labels)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_kept_documents(spark, awkward):
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    kept = quality.kept_documents(awkward, labels)
    assert kept.columns == awkward.columns
    assert kept.collect() == []
    long = spark.createDataFrame([(i, " ".join(f"w{i}x{k}" for k in range(60)), "x") for i in [1, 2, 2, None]] + [(3, "short", "y")], "doc_id long, text string, kept string")
    assert sorted((r.doc_id or 0) for r in quality.kept_documents(long, labels.limit(0)).collect()) == [0, 1, 2, 2]
