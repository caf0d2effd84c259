import pytest

AWKWARD = [
    (1, "The cat sat on the mat. Don't we'll see 'em? 12,345.67  x\n\n  y \t\n"),
    (2, None),
    (3, ""),
    (4, "   \n "),
    (5, "naïve café ΑΣ ΟΔΟΣ İstanbul ſtraße 漢字 かな 😀 é  　 nbsp"),
    (6, "special <|endoftext|> inside<|startoftext|><|endoftext|>"),
    (7, "word " * 3000),
    (8, "abc" * 4000),
    (9, "'s 't x's ''ll 'LL l'l \x00\x1c control"),
    (1, "The cat sat on the mat. Don't we'll see 'em? 12,345.67  x\n\n  y \t\n"),
    (1, "another text of the same id"),
    (None, "no id at all"),
    (None, None),
]


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls, empty and long texts, repeated rows and ids, and a further column whose name may clash."""
    rows = [(i, t, "x", 7) for i, t in AWKWARD]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, shard int").repartition(3)


@pytest.fixture(scope="session")
def no_rows(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)
