import hashlib

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from loomspark.llm import pii
from loomspark.llm.common import read
from tests.llm import test_decontamination, test_near_dedup, test_quality
from tests.llm.test_tokens import WORDS
from tests.llm.conftest import rows_of


def test_against_brute_force(spark):
    d = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in read(spark, d, "documents").collect()}
    trusted = {r.doc_id for r in read(spark, d, "labels").collect() if r.quality == 1}
    kept = {r[0]: docs[r[0]] for r in test_quality.expected(list(docs.items()), trusted) if r[-1]}
    kept = {i: kept[i] for i in test_near_dedup.kept(kept)}
    items = [tuple(r) for r in read(spark, d, "benchmark").collect()]
    for i, *_ in test_decontamination.expected(list(kept.items()), items):
        kept.pop(i, None)
    frame = spark.createDataFrame(list(kept.items()), "doc_id long, text string")
    spelt = {(r.kind, r.value): r.surrogate for r in pii.surrogate_table(frame, pii.DEFAULT_KEY).collect()}
    want = []
    for i, t in kept.items():
        new, _ = pii.replaced(t, pii.DEFAULT_KEY, lambda k, v: spelt[k, v])
        ids = WORDS.encode(new, add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(WORDS.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert rows_of(corpus_pipeline.run(spark, d)) == sorted(want, key=repr)
    assert 0 < len(want) < len(docs)


def test_empty_and_hard_tables(spark):
    """A pipeline of no documents gives none; clashing columns and nulls pass all stages but the last."""
    d = "/root/testdata/sf0.001"
    docs = read(spark, d, "documents").limit(30)
    none = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, d).collect() == []
    names = "gone_id digest row root node key stays n n_entities component_id".split()
    hard = docs.union(spark.createDataFrame([(None, None, None, None, None), (5, "", "en", "x", 0)], docs.schema))
    for name in names:
        hard = hard.withColumn(name, F.lit(name))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, hard, d)
        assert got.columns == hard.columns
        assert all(r[n] == n for r in got.collect() for n in names)


def test_stages_return_the_columns_of_documents(spark):
    d = "/root/testdata/sf0.001"
    docs = read(spark, d, "documents").limit(40)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, d).collect(), docs.schema)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_entry_imports_without_the_operators(monkeypatch):
    import builtins
    import importlib

    import __spark_entry__

    real = builtins.__import__

    def missing(name, *args, **kwargs):
        if name.startswith(("loomspark.llm", "corpus_pipeline")) or name == "loomspark.llm":
            raise ImportError(name)
        return real(name, *args, **kwargs)

    monkeypatch.setattr(builtins, "__import__", missing)
    entry = importlib.reload(__spark_entry__)
    assert not any(q.startswith("op") or q == "pipeline" for q in entry.queries())
    monkeypatch.undo()
    assert "pipeline" in importlib.reload(__spark_entry__).queries()
