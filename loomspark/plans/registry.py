"""Queries over the test tables, each with the SQL that must give the same rows.

The panel is lineitem by supplier and ship date; bars are events by user and minute. Prices of the panel are whole
cents, so that they are the same however they were summed. Values are rounded on both sides, a little above, so
that halves do not depend on how a number is held.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function (spark, sf_dir) under its name."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Added before rounding.
NUDGE = 1e-7


def rounded(df: DataFrame, *columns: str, digits: int = 4) -> DataFrame:
    """The columns, doubles to so many digits, whole numbers as longs."""
    kinds = {f.name: f.dataType for f in df.schema}
    out = []
    for c in columns:
        if isinstance(kinds[c], (T.DoubleType, T.FloatType, T.DecimalType)):
            out.append((F.round(F.col(c).cast("double") + NUDGE, digits) + 0.0).alias(c))
        elif isinstance(kinds[c], (T.ByteType, T.ShortType, T.IntegerType)):
            out.append(F.col(c).cast("long").alias(c))
        else:
            out.append(F.col(c))
    return df.select(*out)


#: Lines of a task of whole dates, and tasks at most: there are not more dates than a calendar has.
LINES_OF_TASK, MOST_TASKS = 1 << 16, 1 << 12


def by_date(spark: SparkSession, sf_dir: str, df: DataFrame) -> DataFrame:
    """Rows of lineitem or of the panel with each date in one of as many tasks as the lines ask for.

    Windows, ranks and groups by date work within these tasks: what one holds in memory does not grow with the table
    as long as there are more dates than tasks, and is a few dates' rows beyond. Lines are counted by the file's footer.
    """
    lines = table(spark, sf_dir, "lineitem").count()
    return df.repartition(min(MOST_TASKS, 1 + lines // LINES_OF_TASK), "trade_date")


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each symbol and date; a date's rows are in one task."""
    rows = table(spark, sf_dir, "lineitem")
    cents, quantity = F.round(F.col("l_extendedprice") * 100).cast("long"), F.col("l_quantity").cast("long")
    points = lambda c: F.round(F.col(c) * 100).cast("long")
    symbol, day = F.col("l_suppkey").cast("long"), F.to_date("l_shipdate")
    rows = rows.select(symbol.alias("symbol"), day.alias("trade_date"), "l_orderkey", cents.alias("c"), quantity.alias("q"), points("l_discount").alias("d"), points("l_tax").alias("t"))
    return by_date(spark, sf_dir, rows).groupBy("symbol", "trade_date").agg(
        (F.expr("sum(c) div sum(q)") / 100.0).alias("close"),
        (F.expr("max(c div q)") / 100.0).alias("high"),
        (F.expr("min(c div q)") / 100.0).alias("low"),
        F.sum("q").cast("double").alias("volume"),
        (F.sum("c") / 100.0).alias("amount"),
        (F.expr("sum(d) * 100 div count(*)") / 10000.0).alias("turnover"),
        F.when(F.pmod(F.min("l_orderkey"), F.lit(7)) != 0, F.expr("sum(t) * 100 div count(*)") / 10000.0).alias("pb"),
        F.count(F.lit(1)).alias("n_lines"),
        F.first(F.pmod("symbol", F.lit(5))).alias("industry"),
    )


PANEL_SQL = """lines AS (
  SELECT CAST(l_suppkey AS BIGINT) AS symbol, CAST(l_shipdate AS DATE) AS trade_date, l_orderkey,
    CAST(round(l_extendedprice * 100) AS BIGINT) AS c, CAST(l_quantity AS BIGINT) AS q,
    CAST(round(l_discount * 100) AS BIGINT) AS d, CAST(round(l_tax * 100) AS BIGINT) AS t FROM lineitem),
panel AS (
  SELECT symbol, trade_date, CAST(sum(c) // sum(q) AS DOUBLE) / 100.0 AS close, max(c // q) / 100.0 AS high, min(c // q) / 100.0 AS low,
    CAST(sum(q) AS DOUBLE) AS volume, CAST(sum(c) AS DOUBLE) / 100.0 AS amount, CAST(sum(d) * 100 // count(*) AS DOUBLE) / 10000.0 AS turnover,
    CASE WHEN min(l_orderkey) % 7 <> 0 THEN CAST(sum(t) * 100 // count(*) AS DOUBLE) / 10000.0 END AS pb,
    count(*) AS n_lines, CAST(symbol % 5 AS BIGINT) AS industry
  FROM lines GROUP BY symbol, trade_date)"""


def r6(expression: str, name: str | None = None, digits: int = 4) -> str:
    return f"round(CAST({expression} AS DOUBLE) + {NUDGE}, {digits}) + 0.0 AS {name or expression}"


def pct_sql(x: str, group: str = "trade_date") -> str:
    """The percent rank with average ties."""
    return (
        f"CASE WHEN {x} IS NOT NULL THEN (rank() OVER (PARTITION BY {group} ORDER BY {x} ASC NULLS LAST)"
        f" + (count({x}) OVER (PARTITION BY {group}, {x}) - 1) / 2.0) / count({x}) OVER (PARTITION BY {group}) END"
    )


def avg_rank_sql(x: str, group: str = "trade_date") -> str:
    return f"CASE WHEN {x} IS NOT NULL THEN rank() OVER (PARTITION BY {group} ORDER BY {x} ASC NULLS LAST) + (count({x}) OVER (PARTITION BY {group}, {x}) - 1) / 2.0 END"


def corr_sql(x: str, y: str) -> str:
    return f"covar_pop({x}, {y}) / nullif(stddev_pop(CASE WHEN {y} IS NOT NULL THEN {x} END) * stddev_pop(CASE WHEN {x} IS NOT NULL THEN {y} END), 0)"
