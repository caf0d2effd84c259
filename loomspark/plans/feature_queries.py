"""Queries of composed features."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspark.operators import diagnostics as dg
from loomspark.operators import features as ft
from loomspark.operators import joins
from loomspark.plans.diagnostic_queries import FWD, SERIES_SQL, forward, ranked_sql, series
from loomspark.plans.event_queries import CONTEXT_SQL, REPORTS_SQL, context, reports
from loomspark.plans.panel_queries import BOTTOM
from loomspark.plans.registry import PANEL_SQL, by_date, corr_sql, panel, pct_sql, query, r6, rounded


@query(f"""WITH {PANEL_SQL}, v AS (SELECT *, CASE WHEN pb > 0 THEN 1 / pb END AS i FROM panel) SELECT symbol, trade_date, {r6(pct_sql('i'), 'pb_rank')}, i IS NOT NULL AS pb_observed, {r6('avg(CAST(i IS NOT NULL AS INT)) OVER (PARTITION BY trade_date)', 'pb_coverage')} FROM v""")
def value_features(spark, d):
    return rounded(ft.value_features(panel(spark, d), ["pb"]), "symbol", "trade_date", "pb_rank", "pb_observed", "pb_coverage")


@query(f"""WITH {PANEL_SQL}, r AS (SELECT *, 0.75 * {BOTTOM.format(x='close')} AS a, 0.25 * (1 - {BOTTOM.format(x='pb')}) AS b, {BOTTOM.format(x='volume')} AS t FROM panel)
SELECT symbol, trade_date, {r6('least(greatest((a + b + 0.01 * t) / 1.01, 0), 1)', 'score')}, CASE WHEN a >= b - 1e-9 THEN 'close' ELSE 'pb' END AS score_reason FROM r""")
def composite_score(spark, d):
    df = ft.composite_score(panel(spark, d), {"close": 0.75, "pb": -0.25}, "volume")
    return rounded(df, "symbol", "trade_date", "score", "score_reason")


W6 = "OVER (ORDER BY period_end ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)"


@query(f"""WITH {CONTEXT_SQL}, d AS (SELECT *, row_number() OVER h AS k, value - lag(value) OVER h AS d1, value - lag(value, 6) OVER h AS d6, stddev_pop(value) {W6} AS s, avg(value) {W6} AS m, count(value) {W6} AS n FROM context WINDOW h AS (ORDER BY period_end)),
p AS (SELECT a.period_end, count(*) FILTER (b.value <= a.value) / count(*) AS p FROM d a JOIN d b ON b.k BETWEEN a.k - 5 AND a.k GROUP BY 1)
SELECT d.period_end, {r6('CASE WHEN k >= 4 THEN d1 END', 'diff_1')}, {r6('CASE WHEN k >= 4 THEN d6 END', 'diff_6')}, {r6('CASE WHEN k >= 4 THEN d1 - lag(d1) OVER (ORDER BY d.period_end) END', 'second_diff')}, {r6('CASE WHEN k >= 4 THEN d.value - y.value END', 'yoy')},
  {r6('CASE WHEN k >= 4 AND n >= 6 AND s > 0 THEN (d.value - m) / s END', 'zscore')}, {r6('CASE WHEN k >= 4 AND n >= 6 THEN p.p END', 'percentile')} FROM d JOIN p USING (period_end) LEFT JOIN context y ON y.period_end = d.period_end - INTERVAL 12 MONTH""")
def context_features(spark, d):
    df = ft.context_features(context(spark, d).withColumnRenamed("feature", "series_id"), 6, 4)
    return rounded(df, "period_end", "diff_1", "diff_6", "second_diff", "yoy", "zscore", "percentile")


@query(f"""WITH {PANEL_SQL}, {CONTEXT_SQL} SELECT p.symbol, p.trade_date, {r6('c.value * (p.industry - 2) / 4.0', 'interaction')} FROM panel p ASOF LEFT JOIN context c ON p.trade_date >= c.visible""")
def context_interaction(spark, d):
    df = joins.context_as_of(panel(spark, d), context(spark, d), ["orders"])
    return rounded(df.withColumn("interaction", F.col("orders") * (F.col("industry") - 2) / 4.0), "symbol", "trade_date", "interaction")


@query(f"""WITH {REPORTS_SQL}, j AS (SELECT a.symbol, a.period, a.value AS x, b.value AS y, a.n AS u, CASE WHEN b.n % 5 <> 0 THEN b.n END AS v FROM reports a LEFT JOIN reports b ON a.symbol = b.symbol AND b.period = a.period + INTERVAL 12 MONTH) SELECT symbol, period, (y >= 0.8 * x) AND (v >= 0.9 * u) AS retained FROM j""")
def retention_label(spark, d):
    r = reports(spark, d)
    later = r.select("symbol", F.add_months("period", -12).alias("period"), F.col("value").alias("y"), F.when(F.col("n") % 5 != 0, F.col("n")).alias("v"))
    df = ft.retention_label(r.join(later, ["symbol", "period"], "left"), ["value", "n"], ["y", "v"], [0.8, 0.9])
    return df.select("symbol", "period", "retained")


@query(f"""WITH {FWD}, e AS (SELECT max(trade_date) AS trade_date FROM panel GROUP BY date_trunc('month', trade_date)), c AS (SELECT f.* FROM f JOIN e USING (trade_date) WHERE pb IS NOT NULL AND fwd IS NOT NULL), q AS (SELECT *, quantile_cont(fwd, 0.1) OVER g AS lo, quantile_cont(fwd, 0.9) OVER g AS hi, count(*) OVER g AS n FROM c WINDOW g AS (PARTITION BY trade_date))
SELECT symbol, trade_date, {r6('least(greatest(fwd, lo), hi)', 'fwd')}, {r6(pct_sql('pb') + ' - 0.5', 'pb')} FROM q WHERE n >= 8""")
def modelling_frame(spark, d):
    return rounded(ft.modelling_frame(forward(spark, d), ["pb"], "fwd", "M", "rank", 0.1, 8), "symbol", "trade_date", "fwd", "pb")


@query(f"""WITH {PANEL_SQL}, {SERIES_SQL}, m AS (SELECT unnest([1, 6]) AS months), l AS (SELECT max(trade_date) AS l FROM s) SELECT CAST(months AS BIGINT) AS months, count(x) AS n, {r6('avg(x)', 'mean')}, {r6('exp(sum(ln(1 + x))) - 1', 'total')}, {r6('avg(x) / stddev_samp(x) * sqrt(252)', 'sharpe')} FROM s, l, m WHERE trade_date > CASE months WHEN 1 THEN l - INTERVAL 1 MONTH ELSE l - INTERVAL 6 MONTH END GROUP BY 1""")
def recent_slices(spark, d):
    return rounded(ft.recent_slices(series(spark, d), "x", "trade_date", [1, 6], 252.0), "months", "n", "mean", "total", "sharpe")


@query(f"""WITH {FWD}, g AS (SELECT *, lead(fwd, 10) OVER (PARTITION BY symbol ORDER BY trade_date) AS far FROM f), {ranked_sql('pb', 'far', 'g')}, i AS (SELECT trade_date, {corr_sql('a', 'b')} AS ic FROM rk GROUP BY 1 HAVING count(DISTINCT y) >= 2 AND {corr_sql('a', 'b')} IS NOT NULL) SELECT count(*) AS n, {r6('avg(ic)', 'mean')}, {r6('stddev_pop(ic)', 'std')} FROM i""")
def negative_control_shift(spark, d):
    df = by_date(spark, d, ft.shifted_target(forward(spark, d), "fwd", 10).select("symbol", "trade_date", "pb", "shifted_target"))
    return rounded(dg.summarize_ic(dg.daily_ic(df, "pb", "shifted_target")), "n", "mean", "std")
