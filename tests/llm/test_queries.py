import duckdb
import pytest

from loomspark.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.execute(f"create view {t} as select * from read_parquet('{folder}/{t}.parquet')")
    df = queries.queries()[name](spark, folder)
    cursor = con.execute(queries.oracle_sql()[name])
    names = [x[0] for x in cursor.description]
    assert sorted(names) == sorted(df.columns)
    rows = cursor.fetchall()
    assert rows
    assert sorted(map(tuple, df.select(names).collect()), key=repr) == sorted(rows, key=repr)
