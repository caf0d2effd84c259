"""How the sources of a language differ in their terms, by shards of languages and terms counted in DuckDB.

Tasks count the terms of the documents they read with SQL, those counts are dealt to shards by a hash of language and
term, and SQL in each shard adds them up, keeps the terms of enough documents, and later sums over the shard's terms
what each pair of sources differs by. Spark merges the shards' sums and ranks them.

With p a source's share of a term, q the other's, and p0, q0 their shares of a term that they do not have, the sum of
f(p, q) over all V kept terms is taken apart, so that no shard needs a source's missing terms::

    V f(p0, q0)  +  over the source's terms: f(p, q0) - f(p0, q0)  +  over the other's terms: f(p0, q) - f(p0, q0)
                 +  over the terms of both:  f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0)

The second and third sums depend on a term's count alone, and are made from the number of terms of each count; the
last one is the shards' work. All shares are whole numbers of 1e-9 and all sums are exact.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import duckdb
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspark.llm.common import through_table

TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
SCALE = 1_000_000_000
LEAST_DOCUMENTS = 3
TOP = 200
#: Characters of documents that a task counts at a time; of a longer document, those of a part.
RUN, PART = 1 << 24, 1 << 20
BETWEEN = re.compile(r"[\x00-\x40\x5B-\x60\x7B-\x7F]")

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTIAL_SQL = f"""
SELECT lang, source, term, CAST(sum(n) AS BIGINT) AS n, count(*) AS docs
FROM (SELECT row, lang, source, term, count(*) AS n
      FROM (SELECT row, lang, source, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}')) AS term FROM run)
      GROUP BY ALL)
GROUP BY lang, source, term
"""
COUNT_SQL = """
WITH cells AS (SELECT lang, source, term, sum(n) AS n, sum(docs) AS docs FROM shard GROUP BY ALL)
SELECT lang, source, term, CAST(n AS BIGINT) AS n, CAST(sum(n) OVER whole AS BIGINT) AS lang_n, row_number() OVER (whole ORDER BY source) = 1 AS first
FROM cells WINDOW whole AS (PARTITION BY lang, term) QUALIFY sum(docs) OVER whole >= {least}
"""
#: p0: the share of a term of count 0.
SHARES_SQL = f"""
CREATE TEMP TABLE shares AS SELECT lang, source, term,
  CAST(1 + CAST({SCALE} AS HUGEINT) * (n + 1) // (own_total + v) AS BIGINT) AS p,
  CAST(1 + {SCALE} // (own_total + v) AS BIGINT) AS p0,
  CAST(1 + CAST({SCALE} AS HUGEINT) * (lang_n + 1) // (lang_total + v) AS BIGINT) AS q
FROM shard
"""
TERMS_SQL = """
SELECT lang, source, 'term' AS part, term AS item, CAST((p - q) * (p - q) // q AS DECIMAL(38, 0)) AS value FROM shares WHERE p > q
QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, term) <= {top}
"""
PAIRS_SQL = """
SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(sum(CAST(
  (a.p - b.p) * (a.p - b.p) // b.p - (a.p - b.p0) * (a.p - b.p0) // b.p0 - (a.p0 - b.p) * (a.p0 - b.p) // b.p + (a.p0 - b.p0) * (a.p0 - b.p0) // b.p0
  AS HUGEINT)) AS DECIMAL(38, 0)) AS value
FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
"""
PARTIAL = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])
CELLS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("lang_n", pa.int64()), ("first", pa.bool_())])
FOUND = pa.schema([("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.string()), ("value", pa.decimal128(38, 0))])


def connected() -> duckdb.DuckDBPyConnection:
    """A database in memory for one task, on the task's own core."""
    con = duckdb.connect()
    con.execute("SET threads = 1; SET preserve_insertion_order = false; SET memory_limit = '800MB'")
    return con


def answers(con: duckdb.DuckDBPyConnection, sql: str, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in con.sql(sql).to_arrow_reader(1 << 16):
        yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(batch.columns, schema)], schema=schema)


def parts(text: str) -> Iterator[str]:
    """The text in parts of about PART characters, cut where no term is."""
    at = 0
    while at < len(text):
        end = BETWEEN.search(text, at + PART) if len(text) - at > PART else None
        stop = end.start() if end else len(text)
        yield text[at:stop]
        at = stop


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """row, lang, source, text: whole documents with about RUN characters; long texts in several rows of one number."""
    rows: list[tuple[int, str, str, str]] = []
    size = number = 0
    for batch in batches:
        langs, sources = (batch.column(i).to_pylist() for i in (0, 1))
        for k in range(batch.num_rows):
            text = batch.column(2)[k].as_py()
            rows += [(number, langs[k], sources[k], x) for x in parts(text)]
            number, size = number + 1, size + len(text)
            if size >= RUN:
                yield pa.table(list(map(list, zip(*rows))), ["row", "lang", "source", "text"])
                rows, size = [], 0
    if rows:
        yield pa.table(list(map(list, zip(*rows))), ["row", "lang", "source", "text"])


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    con = connected()
    for run in runs(batches):
        con.register("run", run)
        yield from answers(con, PARTIAL_SQL, PARTIAL)
        con.unregister("run")


def shard_of(batches: Iterator[pa.RecordBatch]) -> tuple[duckdb.DuckDBPyConnection | None, pa.RecordBatchReader | None]:
    """A database, and the shard's rows as a stream that it reads once; None where the shard is empty."""
    first = next(batches, None)
    if first is None:
        return None, None

    def stream():
        yield first
        yield from batches

    con = connected()
    reader = pa.RecordBatchReader.from_batches(first.schema, stream())
    con.register("shard", reader)
    return con, reader


def kept_terms(docs: DataFrame, least: int) -> DataFrame:
    """lang, source, term, n, lang_n, first: occurrences of each kept term in each source that has it, and in the
    language; first: in one row of each term of a language."""

    def count(batches):
        con, _ = shard_of(iter(batches))
        if con:
            yield from answers(con, COUNT_SQL.format(least=least), CELLS)

    partial = docs.mapInArrow(counted, "lang string, source string, term string, n long, docs long")
    return partial.repartition("lang", "term").mapInArrow(count, "lang string, source string, term string, n long, lang_n long, first boolean")


def shard_sums(cells: DataFrame, top: int) -> DataFrame:
    """lang, source, part, item, value: each shard's first terms of each source, and its sums over terms of both of
    a pair of sources. cells: kept terms with own_total, lang_total and v."""

    def sums(batches):
        con, _ = shard_of(iter(batches))
        if con:
            con.execute(SHARES_SQL)
            for sql in (TERMS_SQL.format(top=top), PAIRS_SQL):
                yield from answers(con, sql, FOUND)

    columns = cells.select("lang", "source", "term", "n", "lang_n", "own_total", "lang_total", "v")
    return columns.repartition("lang", "term").mapInArrow(sums, "lang string, source string, part string, item string, value decimal(38,0)")


def share(count: Column, total: Column, v: Column) -> Column:
    parts_of = F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * (count + 1).cast("decimal(20,0)"), (total + v).cast("decimal(20,0)"))
    return (1 + parts_of).cast("long")


def difference(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q).cast("decimal(38,0)")


def source_divergence(docs: DataFrame, top: int = TOP, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """lang, source, part, item, value, rank: how far each source of a language is from each other one (part ``pair``,
    all of them) and its ``top`` terms that stand out from the language (part ``term``).

    docs: lang, source, text; null is read as empty, and other columns are ignored. A row is a document: repeated rows
    count as often as they are there. A source without terms, or a text of white space, still is a group of its
    language; where a language keeps no term, values of pairs are 0 and there are no terms. Texts are counted in parts
    that cut no term, however long they are. Ties rank by item. No rows: no rows.
    """
    text = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")]
    rows = docs.select(*text)
    cells = through_table(kept_terms(rows, least), "kept-terms")
    totals = cells.groupBy("lang", "source").agg(F.sum("n").alias("own_total"), F.sum(F.col("first").cast("long")).alias("own_first"))
    groups = rows.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").select("lang", "source", F.coalesce("own_total", F.lit(0)).alias("own_total"), F.coalesce("own_first", F.lit(0)).alias("own_first"))
    langs = groups.groupBy("lang").agg(F.sum("own_total").alias("lang_total"), F.sum("own_first").alias("v"))
    groups = through_table(groups.join(langs, "lang").drop("own_first").withColumn("p0", F.when(F.col("v") > 0, share(F.lit(0), F.col("own_total"), F.col("v")))), "source-groups")
    found = through_table(shard_sums(cells.join(groups.drop("p0"), ["lang", "source"]), top), "shard-sums")

    other = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"))
    own = groups.select("lang", "source", "v", "p0").join(other, "lang").filter("source <> item")
    base = own.select("lang", "source", "item", F.coalesce(F.col("v") * difference(F.col("p0"), F.col("q0")), F.lit(0).cast("decimal(38,0)")).cast("decimal(38,0)").alias("value"))
    # of each source, the terms of each count stand for all others of that count
    counts = cells.groupBy("lang", "source", "n").agg(F.count(F.lit(1)).alias("terms")).join(groups, ["lang", "source"])
    counts = counts.withColumn("p", share(F.col("n"), F.col("own_total"), F.col("v"))).join(other, "lang").filter("source <> item")
    there = F.col("terms") * (difference(F.col("p"), F.col("q0")) - difference(F.col("p0"), F.col("q0")))
    back = F.col("terms") * (difference(F.col("q0"), F.col("p")) - difference(F.col("q0"), F.col("p0")))
    both = F.explode(F.array(F.struct("source", "item", there.cast("decimal(38,0)").alias("value")), F.struct(F.col("item").alias("source"), F.col("source").alias("item"), back.cast("decimal(38,0)").alias("value"))))
    single = counts.select("lang", both.alias("x")).select("lang", "x.*")
    pairs = base.unionByName(single).unionByName(found.filter("part = 'pair'").select("lang", "source", "item", "value"))
    pairs = pairs.groupBy("lang", "source", "item").agg(F.sum("value").cast("long").alias("value")).withColumn("part", F.lit("pair"))
    terms = found.filter("part = 'term'").select("lang", "source", "item", F.col("value").cast("long").alias("value"), "part")

    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = pairs.withColumn("rank", F.row_number().over(order)).unionByName(terms.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top))
    return ranked.select("lang", "source", "part", "item", "value", "rank")
