"""Queries of expanding percentiles, crowding, the order of differencing and sequential draws."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspark.operators import memory
from loomspark.operators.panel import PANEL
from loomspark.plans.registry import PANEL_SQL, panel, query, r6, rounded


@query(f"""WITH {PANEL_SQL} SELECT a.symbol, a.trade_date, {r6('CASE WHEN any_value(a.pb) IS NOT NULL THEN count(*) FILTER (b.pb <= a.pb) / CAST(count(b.pb) AS DOUBLE) END', 'percentile')} FROM panel a JOIN panel b ON a.symbol = b.symbol AND b.trade_date <= a.trade_date GROUP BY 1, 2""")
def expanding_percentile(spark, d):
    return rounded(memory.expanding_percentile(panel(spark, d), "pb", ["symbol"], "trade_date"), "symbol", "trade_date", "percentile")


INDEX_SQL = "ix AS (SELECT trade_date, CAST(sum(CAST(round(close * 100) AS BIGINT)) FILTER (industry < 2) AS DOUBLE) / count(*) FILTER (industry < 2) AS cl, sum(volume) FILTER (industry < 2) AS al, CAST(sum(CAST(round(close * 100) AS BIGINT)) FILTER (industry >= 2) AS DOUBLE) / count(*) FILTER (industry >= 2) AS cs, sum(volume) FILTER (industry >= 2) AS sa FROM panel GROUP BY 1 HAVING count(*) FILTER (industry < 2) > 0 AND count(*) FILTER (industry >= 2) > 0)"
_WINDOWS = memory.CROWDING_WINDOWS
_SERIES = " UNION ALL ".join(
    f"SELECT trade_date, n, 'momentum' AS kind, {k} AS k, cs / lag(cs, {k}) OVER o - cl / lag(cl, {k}) OVER o AS v FROM nx WINDOW o AS (ORDER BY trade_date) UNION ALL SELECT trade_date, n, 'turnover', {k}, CASE WHEN n > {k} THEN avg(sa / al) OVER (ORDER BY trade_date ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW) END FROM nx"
    for k in _WINDOWS
)


@query(f"""WITH {PANEL_SQL}, {INDEX_SQL}, nx AS (SELECT *, row_number() OVER (ORDER BY trade_date) AS n FROM ix), v AS (SELECT trade_date, n, kind, k, round(v, 12) AS v FROM ({_SERIES})),
p AS (SELECT a.trade_date, a.kind, a.k, count(*) FILTER (b.v <= a.v) / CAST(count(b.v) AS DOUBLE) AS p FROM v a JOIN v b ON a.kind = b.kind AND a.k = b.k AND b.trade_date <= a.trade_date WHERE a.v IS NOT NULL AND a.n > {max(_WINDOWS)} GROUP BY 1, 2, 3),
t AS (SELECT trade_date, kind, list_sum(list_sort(list(p), 'DESC')[:3]) / 3 AS s, list_sum(list_sort(list(1 - p), 'DESC')[:3]) / 3 AS l FROM p GROUP BY 1, 2 HAVING count(p) >= 3)
SELECT nx.trade_date, {r6('avg(s)', 'small_crowding')}, {r6('avg(l)', 'large_crowding')} FROM nx LEFT JOIN t USING (trade_date) GROUP BY 1""")
def size_crowding(spark, d):
    df = panel(spark, d)
    cents = F.sum(F.round(F.col("close") * 100).cast("long")).cast("double") / F.count(F.lit(1))
    large, small = (df.filter(part).groupBy("trade_date").agg(cents.alias("close"), F.sum("volume").alias("amount")) for part in ("industry < 2", "industry >= 2"))
    return rounded(memory.crowding(large, small), "trade_date", "small_crowding", "large_crowding")


@query(None)
def fractional_order(spark, d):
    return rounded(memory.fractional_order(panel(spark, d), "close", threshold=1e-2), "symbol", "d", "adf_t", "correlation", "n")


@query(None)
def sequential_bootstrap(spark, d):
    """Labels of every row of the panel, which last for eight of its symbol's rows, drawn in four replicates."""
    df = panel(spark, d).withColumn("bar", F.row_number().over(PANEL.history()))
    events = df.select("symbol", F.col("bar").alias("event"), F.col("bar").alias("a"), (F.col("bar") + 7).alias("b"))
    return rounded(memory.sequential_bootstrap(events, "event", "a", "b", 4, group=["symbol"]), "symbol", "replicate", "draw", "event")
