"""Queries of random controls, breaks and splits of trials."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspark.operators import controls
from loomspark.operators import inference as inf
from loomspark.operators import time_series as ts
from loomspark.plans.diagnostic_queries import FWD, SERIES_SQL, forward, ranked_sql, series
from loomspark.plans.registry import PANEL_SQL, avg_rank_sql, by_date, corr_sql, panel, query, r6, rounded


def draw_sql(seed: int, *columns: str) -> str:
    return f"(CAST(('0x' || substr(md5(concat_ws('|', '{seed}', {', '.join(columns)})), 1, 13)) AS BIGINT) / {1 << 52}.0)"


CONTROLS_SQL = f"""{FWD}, trials AS (
  SELECT 'baseline' AS control, trade_date, symbol, pb AS px, fwd AS py FROM f
  UNION ALL SELECT 'shifted_label', trade_date, symbol, pb, lead(fwd) OVER (PARTITION BY symbol ORDER BY trade_date) FROM f
  UNION ALL SELECT 'random_feature_' || k, trade_date, symbol, CASE k WHEN 0 THEN {draw_sql(42, 'trade_date', 'symbol')} ELSE {draw_sql(43, 'trade_date', 'symbol')} END, fwd FROM f, range(2) t(k)
  UNION ALL SELECT 'random_universe', trade_date, symbol, pb, fwd FROM f WHERE {draw_sql(42, 'symbol')} < 0.5
  UNION ALL SELECT 'volume', trade_date, symbol, volume, fwd FROM f),
{ranked_sql('px', 'py', 'trials', 'control, trade_date')},
ic AS (SELECT control, trade_date, {corr_sql('a', 'b')} AS ic FROM rk GROUP BY 1, 2 HAVING count(DISTINCT y) >= 2 AND {corr_sql('a', 'b')} IS NOT NULL)"""


@query(f"WITH {CONTROLS_SQL} SELECT control, count(*) AS n, {r6('avg(ic)', 'mean')}, {r6('stddev_pop(ic)', 'std')}, {r6('avg(ic) / stddev_pop(ic) * sqrt(count(*))', 't_stat')} FROM ic GROUP BY 1")
def negative_controls(spark, d):
    found = controls.negative_controls(forward(spark, d), ["pb"], "fwd", random_features=2, sentinels=["volume"], by_date=lambda df: by_date(spark, d, df))
    return rounded(found, "control", "n", "mean", "std", "t_stat")


PERMUTED_SQL = f"""{FWD}, v AS (SELECT run, trade_date, symbol, pb, fwd, CASE WHEN run = 0 THEN 0 ELSE {draw_sql(42, 'run', 'trade_date', 'symbol')} END AS dr FROM f, range(5) t(run) WHERE pb IS NOT NULL AND fwd IS NOT NULL),
w AS (SELECT *, row_number() OVER (PARTITION BY run, trade_date ORDER BY symbol) AS i, row_number() OVER (PARTITION BY run, trade_date ORDER BY dr, symbol) AS j FROM v),
m AS (SELECT a.run, a.trade_date, a.pb AS px, b.fwd AS py FROM w a JOIN w b ON a.run = b.run AND a.trade_date = b.trade_date AND a.i = b.j),
{ranked_sql('px', 'py', 'm', 'run, trade_date')},
ic AS (SELECT run, trade_date, {corr_sql('a', 'b')} AS ic FROM rk GROUP BY 1, 2 HAVING count(DISTINCT y) >= 2 AND {corr_sql('a', 'b')} IS NOT NULL),
runs AS (SELECT run, count(*) AS n_dates, avg(ic) AS mean_ic FROM ic GROUP BY 1)"""


@query(f"WITH {PERMUTED_SQL} SELECT run, n_dates, {r6('mean_ic')} FROM runs")
def permuted_ic(spark, d):
    return rounded(controls.permuted_ic(forward(spark, d), "pb", "fwd", 4), "run", "n_dates", "mean_ic")


@query(f"""WITH {PERMUTED_SQL}, o AS (SELECT mean_ic AS o FROM runs WHERE run = 0) SELECT {r6('max(o)', 'observed')}, {r6('avg(mean_ic)', 'mean')}, count(*) AS runs, {r6('(count(*) FILTER (mean_ic >= o) + 1) / (count(*) + 1)', 'p_value')} FROM runs, o WHERE run > 0""")
def permutation_test(spark, d):
    found = controls.permutation_test(controls.permuted_ic(forward(spark, d), "pb", "fwd", 4))
    return rounded(found, "observed", "mean", "runs", "p_value")


@query(f"""WITH {PANEL_SQL}, {SERIES_SQL}, k AS (SELECT row_number() OVER (ORDER BY trade_date) - 1 AS place, count(*) OVER () AS n, x AS r FROM s WHERE x IS NOT NULL),
steps AS (SELECT scenario, k.place AS step, CAST((floor({draw_sql(42, 'scenario', 'k.place // 5')} * n) + k.place % 5) AS BIGINT) % n AS place FROM k, range(20) t(scenario)),
path AS (SELECT scenario, step, r, sum(ln(1 + r)) OVER (PARTITION BY scenario ORDER BY step) AS l FROM steps JOIN k USING (place)),
falls AS (SELECT *, exp(l - max(l) OVER (PARTITION BY scenario ORDER BY step)) - 1 AS fall FROM path)
SELECT scenario, count(*) AS n, {r6('exp(sum(ln(1 + r))) - 1', 'total_return')}, {r6('avg(r)', 'mean_return')}, {r6('avg(r) / stddev_samp(r) * sqrt(252)', 'sharpe')}, {r6('min(fall)', 'max_drawdown')} FROM falls GROUP BY 1""")
def block_bootstrap(spark, d):
    found = controls.block_bootstrap(series(spark, d), "x", "trade_date", 20, 5, 252.0)
    return rounded(found, "scenario", "n", "total_return", "mean_return", "sharpe", "max_drawdown")


RESIDUALS_SQL = f"""{PANEL_SQL}, k AS (SELECT symbol, trade_date, volume AS y, amount / 1000 AS x FROM panel WHERE pb IS NOT NULL),
b AS (SELECT *, count(*) OVER w AS n, avg(x) OVER w AS mx, avg(y) OVER w AS my, nullif(var_pop(x) OVER w, 0) AS v, covar_pop(x, y) OVER w AS c FROM k WINDOW w AS (PARTITION BY symbol ORDER BY trade_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
e AS (SELECT symbol, trade_date, CASE WHEN n >= 20 THEN (y - my - c / v * (x - mx)) / sqrt(1 + 1.0 / n + (x - mx) * (x - mx) / (v * n)) END AS r FROM b),
u AS (SELECT *, CASE WHEN r IS NOT NULL THEN sum(r) OVER (PARTITION BY symbol ORDER BY trade_date) END AS cusum, nullif(stddev_samp(r) OVER (PARTITION BY symbol), 0) AS scale FROM e)"""


def residuals(spark, d):
    df = panel(spark, d).filter("pb is not null").withColumn("x", F.col("amount") / 1000)
    return ts.recursive_residuals(df, "volume", "x")


@query(f"WITH {RESIDUALS_SQL} SELECT symbol, trade_date, {r6('r', 'recursive_residual')}, {r6('cusum')}, {r6('cusum / scale', 'standardized_cusum')} FROM u")
def recursive_residuals(spark, d):
    return rounded(residuals(spark, d), "symbol", "trade_date", "recursive_residual", "cusum", "standardized_cusum")


@query(f"WITH {RESIDUALS_SQL} SELECT symbol, count(r) AS observations, count(*) FILTER (cusum / scale >= 3) AS break_count, {r6('max(cusum / scale)', 'maximum')}, {r6('max_by(cusum / scale, trade_date) FILTER (r IS NOT NULL)', 'latest')} FROM u GROUP BY 1")
def break_summary(spark, d):
    found = ts.break_summary(residuals(spark, d), "standardized_cusum", 3.0)
    return rounded(found, "symbol", "observations", "break_count", "maximum", "latest")


@query(f"""WITH {PANEL_SQL}, d AS (SELECT trade_date, CAST(floor((row_number() OVER (ORDER BY trade_date) - 1) * 8 / count(*) OVER ()) AS BIGINT) AS g FROM (SELECT DISTINCT trade_date FROM panel)),
g AS (SELECT g, industry AS c, count(turnover) AS n, sum(turnover) AS s, sum(turnover * turnover) AS q FROM panel JOIN d USING (trade_date) GROUP BY 1, 2),
t AS (SELECT split, c, (split >> g) & 1 AS side, sum(n) AS n, sum(s) AS s, sum(q) AS q FROM g, range(256) r(split) WHERE bit_count(split) = 4 GROUP BY ALL),
h AS (SELECT split, c, side, CASE WHEN n > 1 AND (q - s * s / n) / (n - 1) > 0 THEN s / n / sqrt((q - s * s / n) / (n - 1)) ELSE 0 END AS sharpe FROM t),
e AS (SELECT split, c, max(sharpe) FILTER (side = 1) AS a, max(sharpe) FILTER (side = 0) AS b FROM h GROUP BY ALL),
k AS (SELECT *, {avg_rank_sql('b', 'split')} AS rk, count(*) OVER (PARTITION BY split) AS n FROM e QUALIFY row_number() OVER (PARTITION BY split ORDER BY a DESC, c DESC) = 1)
SELECT split, c AS best, {r6('a', 'train_sharpe')}, {r6('b', 'test_sharpe')}, {r6('rk / (n + 1)', 'relative_rank')}, {r6('ln(rk / (n + 1) / (1 - rk / (n + 1)))', 'logit')} FROM k""")
def overfitting_splits(spark, d):
    sums = inf.group_sums(panel(spark, d).withColumnRenamed("industry", "candidate"), "trade_date", "candidate", "turnover", 8)
    return rounded(inf.overfitting_splits(sums, 8), "split", "best", "train_sharpe", "test_sharpe", "relative_rank", "logit")
