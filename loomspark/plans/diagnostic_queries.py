"""Queries of diagnostics, weights and inference."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspark.functions import recipes as R
from loomspark.operators import diagnostics as dg
from loomspark.operators import inference as inf
from loomspark.operators import models, splits, weights
from loomspark.operators import panel as pn
from loomspark.plans.registry import PANEL_SQL, avg_rank_sql, by_date, corr_sql, panel, query, r6, rounded, table
from loomspark.sources.checkpoints import through_table

FWD = f"""{PANEL_SQL}, f AS (SELECT *, CASE WHEN n_lines % 4 <> 3 THEN lead(close) OVER (PARTITION BY symbol ORDER BY trade_date) / close - 1 END AS fwd FROM panel)"""


def forward(spark, d):
    """The panel with the next row's return; a date's rows are in one task."""
    df = panel(spark, d)
    return by_date(spark, d, df.withColumn("fwd", F.when(F.col("n_lines") % 4 != 3, R.ratio(F.lead("close").over(pn.PANEL.history()), "close") - 1)))


def ranked_sql(x: str, y: str, source: str, group: str = "trade_date", more: str = "") -> str:
    return f"""rk AS (SELECT *, {avg_rank_sql('x', group)} AS a, {avg_rank_sql('y', group)} AS b FROM (SELECT *, CASE WHEN {y} IS NOT NULL THEN {x} END AS x, CASE WHEN {x} IS NOT NULL THEN {y} END AS y{more} FROM {source}))"""


IC = f"{ranked_sql('pb', 'fwd', 'f')}, ic AS (SELECT trade_date, {corr_sql('a', 'b')} AS ic, count(a) AS n_obs FROM rk GROUP BY 1 HAVING count(DISTINCT y) >= 2 AND {corr_sql('a', 'b')} IS NOT NULL)"


@query(f"WITH {FWD}, {IC} SELECT trade_date, {r6('ic')}, n_obs FROM ic")
def daily_rank_ic(spark, d):
    return rounded(dg.daily_ic(forward(spark, d), "pb", "fwd"), "trade_date", "ic", "n_obs")


@query(f"WITH {FWD}, {IC} SELECT count(*) AS n, {r6('avg(ic)', 'mean')}, {r6('stddev_pop(ic)', 'std')}, {r6('avg(ic) / stddev_pop(ic)', 'ir')}, {r6('avg(ic) / stddev_pop(ic) * sqrt(count(*))', 't_stat')} FROM ic")
def ic_summary(spark, d):
    return rounded(dg.summarize_ic(dg.daily_ic(forward(spark, d), "pb", "fwd")), "n", "mean", "std", "ir", "t_stat")


@query(f"WITH {FWD}, p AS (SELECT industry, trade_date, {corr_sql('pb', 'close')} AS ic FROM f GROUP BY 1, 2 HAVING count(DISTINCT CASE WHEN pb IS NOT NULL THEN close END) >= 2 AND {corr_sql('pb', 'close')} IS NOT NULL) SELECT industry, count(*) AS n, {r6('avg(ic)', 'mean')} FROM p GROUP BY 1")
def bucket_ic(spark, d):
    ics = dg.daily_ic(forward(spark, d), "pb", "close", "pearson", ["industry"])
    return rounded(dg.summarize_ic(ics, ["industry"]), "industry", "n", "mean")


@query(f"""WITH {PANEL_SQL}, n AS (SELECT *, count(DISTINCT volume) OVER (PARTITION BY trade_date) AS nd, count(*) OVER (PARTITION BY trade_date) AS n, row_number() OVER (PARTITION BY trade_date ORDER BY volume, symbol) AS r FROM panel)
SELECT symbol, trade_date, CASE WHEN nd >= 4 THEN greatest(CAST(ceil((r - 1) * 4.0 / nullif(n - 1, 0)) AS BIGINT) - 1, 0) END AS bucket FROM n""")
def daily_quantile_bucket(spark, d):
    df = panel(spark, d).withColumn("k", F.count(F.lit(1)).over(R.by("trade_date")))
    return rounded(dg.quantile_bucket(df.filter("k > 1"), "volume", 4).unionByName(df.filter("k <= 1").withColumn("bucket", F.lit(None).cast("bigint"))), "symbol", "trade_date", "bucket")


@query(f"""WITH {FWD}, e AS (SELECT industry, fwd AS a, turnover - 0.05 AS p FROM f WHERE fwd IS NOT NULL) SELECT industry, count(*) AS n, {r6('avg(abs(a - p))', 'mae')}, {r6('sqrt(avg((a - p) * (a - p)))', 'rmse')}, {r6('1 - sum((a - p) * (a - p)) / (var_pop(a) * count(*))', 'r2')}, {r6('avg(CAST(sign(a) = sign(p) AS INT))', 'hit_rate')} FROM e GROUP BY 1""")
def regression_errors(spark, d):
    df = forward(spark, d).withColumn("p", F.col("turnover") - 0.05)
    return rounded(dg.errors(df, "fwd", "p", ["industry"]), "industry", "n", "mae", "rmse", "r2", "hit_rate")


@query(f"""WITH {FWD}, b AS (SELECT * FROM f WHERE fwd IS NOT NULL QUALIFY row_number() OVER (PARTITION BY trade_date ORDER BY volume DESC, symbol) <= 5), s AS (SELECT avg(CAST(fwd > 0 AS INT)) AS s FROM b GROUP BY trade_date) SELECT {r6('avg(s)', 'positive_ratio')}, count(*) AS n_dates FROM s""")
def top_k_positive_ratio(spark, d):
    return rounded(dg.top_k_positive(forward(spark, d), "volume", "fwd", 5), "positive_ratio", "n_dates")


SERIES_SQL = "s AS (SELECT trade_date, CAST(floor(sum(CAST(round(turnover * 10000) AS BIGINT)) // count(*)) AS DOUBLE) / 10000.0 - 0.05 AS x, avg(pb) - 0.04 AS y FROM panel GROUP BY 1)"


def series(spark, d):
    return panel(spark, d).groupBy("trade_date").agg((F.expr("sum(cast(round(turnover * 10000) as bigint)) div count(*)") / 10000.0 - 0.05).alias("x"), (F.avg("pb") - 0.04).alias("y"))


@query(f"""WITH {PANEL_SQL}, {SERIES_SQL}, a AS (SELECT *, x - y AS z FROM s WHERE y IS NOT NULL) SELECT count(*) AS n, {r6('avg(z) * 252', 'active_mean')}, {r6('stddev_samp(z) * sqrt(252)', 'tracking_error')}, {r6('regr_slope(x, y)', 'beta')}, {r6(corr_sql('x', 'y'), 'corr')}, {r6('exp(sum(ln(1 + z))) - 1', 'active_total')},
  {r6('avg(z) * 252 / (stddev_samp(z) * sqrt(252))', 'information_ratio')}, {r6('(avg(x) - regr_slope(x, y) * avg(y)) * 252', 'alpha')} FROM a""")
def active_return_summary(spark, d):
    return rounded(dg.active_returns(series(spark, d), "x", "y", 252.0), "n", "active_mean", "tracking_error", "beta", "corr", "active_total", "information_ratio", "alpha")


@query(f"""WITH {PANEL_SQL}, {SERIES_SQL}, v AS (SELECT quantile_cont(x, 0.05) AS v FROM s), p AS (SELECT *, exp(sum(ln(1 + x)) OVER (ORDER BY trade_date)) AS nav FROM s), q AS (SELECT *, nav / greatest(max(nav) OVER (ORDER BY trade_date), 1) - 1 AS dd FROM p)
SELECT count(*) AS n, {r6('exp(sum(ln(1 + x))) - 1', 'total_return')}, {r6('exp(sum(ln(1 + x)) * 252 / count(*)) - 1', 'annual_return')}, {r6('stddev_samp(x) * sqrt(252)', 'volatility')}, {r6('avg(x) / stddev_samp(x) * sqrt(252)', 'sharpe')}, {r6('avg(x) / sqrt(avg(power(least(x, 0), 2))) * sqrt(252)', 'sortino')}, {r6('min(dd)', 'max_drawdown')},
  {r6('skewness(x)', 'skew')}, {r6('kurtosis(x)', 'kurt')}, {r6('max(v)', 'var_95')}, {r6('avg(x) FILTER (x <= v + 1e-9)', 'cvar_95')} FROM q, v""")
def period_return_summary(spark, d):
    return rounded(dg.period_returns(series(spark, d), "x", "trade_date", 252.0), "n", "total_return", "annual_return", "volatility", "sharpe", "sortino", "max_drawdown", "skew", "kurt", "var_95", "cvar_95")


LONG = f"l AS (SELECT symbol, trade_date, fwd, industry, factor, value FROM (SELECT symbol, trade_date, fwd, industry, pb, volume FROM f) UNPIVOT INCLUDE NULLS (value FOR factor IN (pb, volume)))"


@query(f"""WITH {FWD}, {LONG}, {ranked_sql('value', 'fwd', 'l', 'trade_date, factor')} SELECT trade_date, factor, {r6('avg(CAST(value IS NOT NULL AS INT))', 'coverage')}, {r6('CASE WHEN count(a) >= 2 THEN ' + corr_sql('a', 'b') + ' END', 'rank_ic')}, {r6('avg(value)', 'mean')}, {r6('stddev_samp(value)', 'std')} FROM rk GROUP BY 1, 2""")
def factor_date_diagnostics(spark, d):
    return rounded(dg.factor_dates(forward(spark, d), ["pb", "volume"], "fwd"), "trade_date", "factor", "coverage", "rank_ic", "mean", "std")


@query(f"""WITH {FWD}, {LONG}, cal AS (SELECT trade_date, row_number() OVER (ORDER BY trade_date) AS pos FROM (SELECT DISTINCT trade_date FROM panel)), m AS (SELECT l.*, pos FROM l JOIN cal USING (trade_date) WHERE value IS NOT NULL),
j AS (SELECT m.trade_date, m.factor, m.value, b.value AS old FROM m JOIN m b ON b.symbol = m.symbol AND b.factor = m.factor AND b.pos = m.pos - 2), {ranked_sql('value', 'old', 'j', 'trade_date, factor')} SELECT trade_date, factor, count(*) AS n_obs, {r6(corr_sql('a', 'b'), 'autocorrelation')} FROM rk GROUP BY 1, 2""")
def factor_drift(spark, d):
    return rounded(dg.factor_drift(forward(spark, d), ["pb", "volume"], 2), "trade_date", "factor", "n_obs", "autocorrelation")


@query(f"""WITH {FWD}, {LONG}, c AS (SELECT * FROM l WHERE value IS NOT NULL AND fwd IS NOT NULL), {ranked_sql('value', 'fwd', 'c', 'trade_date, factor, industry')}, g AS (SELECT *, count(*) OVER w0 AS n, row_number() OVER (PARTITION BY trade_date, factor, industry ORDER BY value, symbol) AS r FROM rk WINDOW w0 AS (PARTITION BY trade_date, factor, industry))
SELECT trade_date, factor, industry, count(*) AS n_obs, {r6(corr_sql('a', 'b'), 'rank_ic')}, {r6('avg(fwd) FILTER (r > n - ceil(n * 0.2)) - avg(fwd) FILTER (r <= ceil(n * 0.2) AND NOT r > n - ceil(n * 0.2))', 'long_short')} FROM g GROUP BY 1, 2, 3""")
def industry_diagnostics(spark, d):
    return rounded(dg.bucket_diagnostics(forward(spark, d), ["pb", "volume"], "fwd", "industry"), "trade_date", "factor", "industry", "n_obs", "rank_ic", "long_short")


@query(f"""WITH {PANEL_SQL}, p AS (SELECT trade_date, 'pb' AS left_factor, 'volume' AS right_factor, pb AS x0, volume AS y0 FROM panel UNION ALL SELECT trade_date, 'pb', 'turnover', pb, turnover FROM panel UNION ALL SELECT trade_date, 'volume', 'turnover', volume, turnover FROM panel),
{ranked_sql('x0', 'y0', 'p', 'trade_date, left_factor, right_factor')}, c AS (SELECT trade_date, left_factor, right_factor, {corr_sql('a', 'b')} AS c FROM rk GROUP BY ALL) SELECT left_factor, right_factor, {r6('avg(c)', 'mean_corr')}, count(c) AS n_dates FROM c GROUP BY 1, 2""")
def factor_correlations(spark, d):
    return rounded(dg.factor_correlations(panel(spark, d), ["pb", "volume", "turnover"]), "left_factor", "right_factor", "mean_corr", "n_dates")


@query(None)
def exposure_residuals(spark, d):
    return rounded(dg.exposure_residuals(forward(spark, d), "pb", "fwd", ["volume", "turnover"], "industry"), "trade_date", "n_obs", "r2", "residual_ic")


@query(f"""WITH {PANEL_SQL}, cal AS (SELECT trade_date, row_number() OVER (ORDER BY trade_date) AS pos FROM (SELECT DISTINCT trade_date FROM panel)), t AS (SELECT symbol, p.trade_date, pos FROM panel p JOIN cal USING (trade_date) QUALIFY row_number() OVER (PARTITION BY p.trade_date ORDER BY volume DESC, symbol) <= 4),
n AS (SELECT trade_date, pos FROM t GROUP BY ALL HAVING count(*) = 4) SELECT n.trade_date, {r6('1 - (SELECT count(*) FROM t a JOIN t b ON a.symbol = b.symbol WHERE a.pos = n.pos AND b.pos = n.pos - 1) / 4.0', 'churn')} FROM n WHERE EXISTS (SELECT 1 FROM n m WHERE m.pos = n.pos - 1)""")
def top_k_churn(spark, d):
    return rounded(dg.churn(panel(spark, d), "volume", 4), "trade_date", "churn")


@query(f"""WITH {PANEL_SQL}, b AS (SELECT close AS v, trade_date < DATE '1998-01-01' AS ref FROM panel), e AS (SELECT list_distinct(quantile_cont(v, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) FILTER (ref)) AS e, count(*) FILTER (ref) AS nr, count(*) FILTER (NOT ref) AS nc FROM b),
k AS (SELECT len(list_filter(e, lambda x: x < v)) AS k, nr, nc, count(*) FILTER (ref) AS r, count(*) FILTER (NOT ref) AS c FROM b, e GROUP BY ALL), psi AS (SELECT sum((greatest(c / nc, 1e-6) - greatest(r / nr, 1e-6)) * ln(greatest(c / nc, 1e-6) / greatest(r / nr, 1e-6))) AS psi FROM k),
s AS (SELECT v, count(*) FILTER (ref) AS r, count(*) FILTER (NOT ref) AS c FROM b GROUP BY v), cs AS (SELECT sum(r) OVER (ORDER BY v) AS cr, sum(c) OVER (ORDER BY v) AS cc FROM s), ks AS (SELECT max(abs(cr / nr - cc / nc)) AS ks FROM cs, e),
m AS (SELECT avg(v) FILTER (ref) AS a, avg(v) FILTER (NOT ref) AS b, stddev_samp(v) FILTER (ref) AS c, stddev_samp(v) FILTER (NOT ref) AS d FROM b) SELECT {r6('psi')}, {r6('ks')}, {r6('(b - a) / c', 'mean_shift_std')}, {r6('d / c', 'std_ratio')} FROM psi, ks, m""")
def signal_drift(spark, d):
    df, cut = panel(spark, d), F.lit("1998-01-01").cast("date")
    return rounded(dg.signal_drift(df.filter(F.col("trade_date") < cut), df.filter(F.col("trade_date") >= cut), "close"), "psi", "ks", "mean_shift_std", "std_ratio")


@query(f"""WITH {FWD} SELECT count(*) AS n_rows, count(DISTINCT trade_date) AS n_dates, count(*) FILTER (pb IS NOT NULL AND fwd IS NOT NULL) AS complete_rows, count(DISTINCT trade_date) FILTER (pb IS NOT NULL AND fwd IS NOT NULL) AS complete_dates, count(*) FILTER (pb IS NULL) AS missing_pb, count(*) FILTER (fwd IS NULL) AS missing_fwd FROM f""")
def feature_availability(spark, d):
    return dg.availability(forward(spark, d), ["pb", "fwd"])


W10 = "OVER (PARTITION BY factor ORDER BY trade_date ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)"


@query(f"""WITH {FWD}, {LONG}, {ranked_sql('value', 'fwd', 'l', 'trade_date, factor')}, i AS (SELECT trade_date, factor, CASE WHEN count(a) >= 2 THEN {corr_sql('a', 'b')} END AS c FROM rk GROUP BY 1, 2), w AS (SELECT *, CASE WHEN count(c) {W10} >= 6 THEN avg(c) {W10} END AS m, CASE WHEN count(c) {W10} >= 6 THEN stddev_samp(c) {W10} END AS s FROM i)
SELECT trade_date, factor, {r6('lag(m) OVER h', 'rolling_ic')}, {r6('lag(CASE WHEN s > 1e-9 THEN m / s END) OVER h', 'rolling_icir')} FROM w WINDOW h AS (PARTITION BY factor ORDER BY trade_date)""")
def rolling_factor_diagnostics(spark, d):
    ics = dg.factor_dates(forward(spark, d), ["pb", "volume"], "fwd")
    return rounded(dg.rolling_factor_stats(ics, 10, 6), "trade_date", "factor", "rolling_ic", "rolling_icir")


@query(f"""WITH {PANEL_SQL}, cal AS (SELECT trade_date, row_number() OVER (ORDER BY trade_date) AS pos FROM (SELECT DISTINCT trade_date FROM panel)), w AS (SELECT symbol, trade_date, power(0.5, ((SELECT max(pos) FROM cal) - pos) / 500.0) AS w, 1.0 / count(*) OVER (PARTITION BY trade_date) AS e FROM panel JOIN cal USING (trade_date))
SELECT symbol, trade_date, {r6('w / avg(w) OVER ()', 'decay_weight')}, {r6('e', 'equal_weight')} FROM w""")
def sample_weights(spark, d):
    df = weights.date_equal(weights.decayed(panel(spark, d), 500.0, "decay_weight"), "equal_weight")
    return rounded(df, "symbol", "trade_date", "decay_weight", "equal_weight")


@query(f"""WITH {PANEL_SQL}, n AS (SELECT symbol AS grp, trade_date AS bar, row_number() OVER (PARTITION BY symbol ORDER BY trade_date) AS n, lead(trade_date, 8) OVER (PARTITION BY symbol ORDER BY trade_date) AS fin FROM panel), e AS (SELECT grp, bar AS a, fin AS b FROM n WHERE fin IS NOT NULL),
c AS (SELECT n.grp, n.bar, count(e.a) AS k FROM n LEFT JOIN e ON e.grp = n.grp AND n.bar BETWEEN a AND b GROUP BY 1, 2) SELECT e.grp, e.a AS label_start, e.b AS label_end, count(*) AS n_bars, {r6('avg(1.0 / k)', 'uniqueness')} FROM e JOIN c ON c.grp = e.grp AND c.bar BETWEEN a AND b GROUP BY 1, 2, 3""")
def label_uniqueness(spark, d):
    return _label_uniqueness(spark, d, "label_end is not null")


def _label_uniqueness(spark, d, starts):
    h = pn.PANEL.history()
    n = panel(spark, d).select(F.col("symbol").alias("grp"), F.col("trade_date").alias("bar"), F.row_number().over(h).alias("n"), F.lead("trade_date", 8).over(h).alias("label_end"))
    e = n.filter(starts).select("grp", F.col("bar").alias("label_start"), "label_end")
    return rounded(weights.average_uniqueness(e, n, "label_start", "label_end", "grp"), "grp", "label_start", "label_end", "n_bars", "uniqueness")


@query(f"""WITH {PANEL_SQL}, d AS (SELECT trade_date, CAST(floor((row_number() OVER (ORDER BY trade_date) - 1) * 8 / count(*) OVER ()) AS BIGINT) AS g FROM (SELECT DISTINCT trade_date FROM panel)) SELECT g AS "group", industry AS candidate, count(turnover) AS n, {r6('sum(turnover)', 's')}, {r6('sum(turnover * turnover)', 'q')} FROM panel JOIN d USING (trade_date) GROUP BY 1, 2""")
def overfitting_group_sums(spark, d):
    df = panel(spark, d).withColumnRenamed("industry", "candidate")
    return rounded(inf.group_sums(df, "trade_date", "candidate", "turnover", 8), "group", "candidate", "n", "s", "q")


@query(f"""WITH {PANEL_SQL}, s AS (SELECT trade_date, avg(turnover) AS a, avg(pb) AS b FROM panel GROUP BY 1 HAVING avg(pb) IS NOT NULL) SELECT * FROM (SELECT 'a' AS left_factor, 'a' AS right_factor, {r6('var_samp(a) * 1e4', 'covariance')}, count(*) AS n_obs FROM s UNION ALL SELECT 'a', 'b', {r6('covar_samp(a, b) * 0.8 * 1e4', 'covariance')}, count(*) FROM s UNION ALL SELECT 'b', 'b', {r6('var_samp(b) * 1e4', 'covariance')}, count(*) FROM s)""")
def factor_covariance(spark, d):
    s = panel(spark, d).groupBy("trade_date").agg(F.avg("turnover").alias("a"), F.avg("pb").alias("b"))
    return rounded(inf.covariance(s, ["a", "b"], 0.2).withColumn("covariance", F.col("covariance") * 1e4), "left_factor", "right_factor", "covariance", "n_obs")


@query(f"""WITH {FWD}, g AS (SELECT date_trunc('month', trade_date) AS m, avg(power(fwd - 0.5, 2) - power(fwd - turnover, 2)) AS gain, count(fwd) AS n FROM f WHERE trade_date + 30 <= DATE '2000-01-01' GROUP BY 1 HAVING count(fwd) >= 20) SELECT count(*) AS formations, {r6('avg(gain)', 'mean_gain')}, {r6('avg(CAST(gain > 0 AS INT))', 'win_share')}, count(*) >= 8 AND avg(gain) > 0 AND avg(CAST(gain > 0 AS INT)) >= 0.6 AS passes FROM g""")
def forecast_skill_gate(spark, d):
    df = forward(spark, d).withColumn("m", F.trunc("trade_date", "month")).withColumn("mature", F.date_add("trade_date", 30)).withColumn("control", F.lit(0.5))
    return rounded(inf.skill_gate(df, "m", "mature", "2000-01-01", "fwd", "turnover", "control"), "formations", "mean_gain", "win_share", "passes")


@query(f"""WITH {PANEL_SQL}, {SERIES_SQL} SELECT trade_date, {r6('CASE WHEN count(x) OVER w >= 60 THEN avg(x) OVER w END', 'rolling_mean')}, {r6('CASE WHEN count(x) OVER w >= 60 THEN avg(x) OVER w / stddev_samp(x) OVER w * sqrt(252) END', 'rolling_sharpe')} FROM s WINDOW w AS (ORDER BY trade_date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)""")
def rolling_sharpe(spark, d):
    return rounded(inf.rolling_series(series(spark, d), "x", "trade_date", 60, 252.0), "trade_date", "rolling_mean", "rolling_sharpe")


@query(None)
def walk_forward_ridge(spark, d):
    df = models.rank_target(forward(spark, d), "fwd").filter("rank_target is not null").select("symbol", "trade_date", "pb", "volume", "turnover", "rank_target")
    df = through_table(df, "rank-targets")  # read by dates, and by each fold's medians, fit and test
    dates = [r[0] for r in df.select("trade_date").distinct().collect()]
    return models.walk(df, splits.walk_forward(dates, 200, 2, gap=5, train_size=400), ["pb", "volume", "turnover"], "rank_target", "ridge", alpha=0.1).select("symbol", "trade_date", "fold", "pred")


@query("""WITH p AS (SELECT (d.doc_id % 12) AS trade_date, (n_chars % 1000) / 1000.0 AS p, quality AS y FROM documents d JOIN labels l USING (doc_id)), b AS (SELECT *, least(CAST(floor(p * 20) AS INT), 19) AS b FROM p),
g AS (SELECT trade_date, b, count(y) AS n, sum(y) AS s FROM b GROUP BY 1, 2), c AS (SELECT x.trade_date, x.p, x.b, x.y, (SELECT coalesce(sum(n), 0) FROM g WHERE g.trade_date < x.trade_date AND g.b = x.b) AS n, (SELECT coalesce(sum(s), 0) FROM g WHERE g.trade_date < x.trade_date AND g.b = x.b) AS s, (SELECT coalesce(sum(n), 0) FROM g WHERE g.trade_date < x.trade_date) AS na, (SELECT coalesce(sum(s), 0) FROM g WHERE g.trade_date < x.trade_date) AS sa FROM b x)
SELECT trade_date, round(p + 1e-07, 4) + 0.0 AS p, round(CAST(CASE WHEN na >= 100 THEN (s + sa / na) / (n + 1) END AS DOUBLE) + 1e-07, 4) + 0.0 AS calibrated FROM c""")
def expanding_calibration(spark, d):
    p = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").select((F.col("doc_id") % 12).alias("trade_date"), ((F.col("n_chars") % 1000) / F.lit(1000.0)).alias("p"), "quality")
    return rounded(models.expanding_calibration(p, "p", "quality", least=100), "trade_date", "p", "calibrated")
