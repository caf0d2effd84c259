import datetime
import decimal
import math

import duckdb
import pytest

from loomspark import plans

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{FOLDER}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return "nan" if isinstance(v, float) and math.isnan(v) else v


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_query_equals_its_sql(spark, duck, name):
    df = plans.queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    cursor = duck.execute(plans.oracle_sql()[name])
    names = [x[0] for x in cursor.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in cursor.fetchall()), key=repr)


def test_rows_may_come_in_any_order(spark):
    from pyspark.sql import functions as F

    from loomspark.operators import cross_section as cs
    from loomspark.operators import time_series as ts
    from loomspark.plans.registry import panel

    df = panel(spark, FOLDER).cache()
    mixed = df.repartition(7, F.rand(3))
    for f in (ts.price_features, lambda x: cs.transform(x, ["pb"], "rank"), lambda x: cs.top_k(x, "close", 3)):
        a, b = (sorted(map(tuple, f(x).collect()), key=repr) for x in (df, mixed))
        assert a == b
