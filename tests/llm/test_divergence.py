import random
import re
from collections import Counter, defaultdict

import pytest

from loomspark.llm import divergence
from loomspark.llm.common import read
from loomspark.llm.divergence import source_divergence
from tests.llm.conftest import rows_of

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def brute(rows, top=200, least=3):
    """Every term against every source, by the definition."""
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    counts, docs, sources = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        text, lang, source = (x or "" for x in (text, lang, source))
        found = TERM.findall(text.translate(lower))
        counts[lang, source].update(found)
        docs[lang].update(set(found))
        sources[lang].add(source)
    out = []
    for lang, names in sources.items():
        kept = [t for t, n in docs[lang].items() if n >= least]
        v = len(kept)

        def shares(of):
            total = sum(of[t] for t in kept)
            return {t: 1 + 10**9 * (of[t] + 1) // (total + v) for t in kept}

        whole = shares(sum((counts[lang, s] for s in names), Counter()))
        of = {s: shares(counts[lang, s]) for s in names}
        for s in names:
            pairs = [(sum((of[s][t] - of[o][t]) ** 2 // of[o][t] for t in kept), o) for o in names if o != s]
            terms = [((of[s][t] - whole[t]) ** 2 // whole[t], t) for t in kept if counts[lang, s][t] and of[s][t] > whole[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most]
                out += [(lang, s, part, item, value, k) for k, (value, item) in enumerate(ranked, 1)]
    return sorted(out, key=repr)


AWKWARD = [
    ("The cat, the CAT; the Cat's.", "en", "a"),
    ("the cat sat\x00on İstanbul ſ é É [x] {y} ^_`", "en", "b"),
    ("the the dog é É cat", "en", "b"),
    ("the the dog é É cat", "en", "b"),
    (None, "en", "silent"),
    ("  123 \n", "en", "silent"),
    ("der Hund", "de", "a"),
    ("eins zwei", "de", None),
    ("漢字 漢字。漢字 the", None, "a"),
    ("漢字 the", None, "b"),
    ("漢字 the", "", "b"),
    ("word " * 3000 + "the cat", "en", "long"),
    ("", None, None),
    ("alone alone alone", "fr", "a"),
]


def frame(spark, rows):
    return spark.createDataFrame([(t, x, s, "clash", 1) for t, x, s in rows], "text string, lang string, source string, term string, n int").repartition(3)


def test_awkward_rows(spark):
    assert rows_of(source_divergence(frame(spark, AWKWARD))) == brute(AWKWARD)


def test_random_rows_and_a_small_top(spark):
    r = random.Random(3)
    words = [f"w{chr(97 + k)}" for k in range(20)]
    rows = [(" ".join(r.choice(words[: r.randint(1, 20)]) for _ in range(r.randint(0, 40))), r.choice(["x", "y"]), r.choice("abcdefg")) for _ in range(120)]
    assert rows_of(source_divergence(frame(spark, rows), top=3)) == brute(rows, top=3)


def test_long_texts_are_cut_between_terms(spark, monkeypatch):
    monkeypatch.setattr(divergence, "PART", 7)
    for text in ("the cat sat on the mat", "abcdefghijklmnop qr", "", " " * 30, "x" * 40):
        cut = list(divergence.parts(text))
        assert "".join(cut) == text
        assert [w for x in cut for w in TERM.findall(x)] == TERM.findall(text)
    monkeypatch.setattr(divergence, "RUN", 20)
    batches = list(divergence.counted(iter(spark.createDataFrame([("en", "a", "the cat sat on the mat the")] * 3, "lang string, source string, text string").toArrow().to_batches())))
    found = Counter()
    for b in batches:
        for row in b.to_pylist():
            found[row["term"]] += row["docs"]
    assert found == {"the": 3, "cat": 3, "sat": 3, "on": 3, "mat": 3}


def test_documents(spark):
    docs = read(spark, "/root/testdata/sf0.001", "documents")
    rows = [(r.text, r.lang, r.source) for r in docs.collect()]
    got = rows_of(source_divergence(docs))
    assert got == brute(rows)
    assert {x[2] for x in got} == {"pair", "term"}


def test_no_rows(spark):
    assert source_divergence(frame(spark, []).filter("false")).collect() == []


@pytest.mark.parametrize("least", [1, 99])
def test_least_documents(spark, least):
    assert rows_of(source_divergence(frame(spark, AWKWARD), least=least)) == brute(AWKWARD, least=least)
