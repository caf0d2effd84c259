"""Queries of the cross-section and time-series operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspark.functions import recipes as R
from loomspark.operators import cross_section as cs
from loomspark.operators import diagnostics as dg
from loomspark.operators import panel as pn
from loomspark.operators import time_series as ts
from loomspark.plans.registry import PANEL_SQL, panel, pct_sql, query, r6, rounded, table

H = "WINDOW h AS (PARTITION BY symbol ORDER BY trade_date)"


def roll_sql(f: str, x: str, n: int, least: int) -> str:
    w = f"OVER (PARTITION BY symbol ORDER BY trade_date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({x}) {w} >= {least} THEN {f} {w} END"


@query(f"""WITH {PANEL_SQL}, feat AS (
  SELECT *, close / lag(close, 5) OVER h - 1 AS mom_5, lead(close, 1) OVER h / close - 1 AS fwd FROM panel {H}),
valid AS (SELECT * FROM feat WHERE mom_5 IS NOT NULL AND fwd IS NOT NULL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY trade_date ORDER BY mom_5, symbol) AS r, count(*) OVER (PARTITION BY trade_date) AS n FROM valid)
SELECT trade_date, greatest(CAST(ceil((r - 1) * 5.0 / (n - 1)) AS BIGINT) - 1, 0) AS quantile, {r6('avg(fwd)', 'mean_target')}, count(*) AS n_obs
FROM ranked WHERE n >= 5 GROUP BY 1, 2""")
def panel_momentum_quantiles(spark, d):
    h = pn.PANEL.history()
    df = panel(spark, d).withColumn("mom_5", R.pct_change("close", h, 5)).withColumn("fwd", R.ratio(F.lead("close").over(h), "close") - 1)
    return rounded(dg.quantile_returns(df, "mom_5", "fwd", 5), "trade_date", "quantile", "mean_target", "n_obs")


@query(f"""WITH {PANEL_SQL}, a AS (SELECT *, close / lag(close) OVER h - 1 AS ret_1d,
  close / lag(close, 5) OVER h - 1 AS mom_5, close / lag(close, 20) OVER h - 1 AS mom_20, close / lag(close, 60) OVER h - 1 AS mom_60, close / lag(close, 120) OVER h - 1 AS mom_120 FROM panel {H}),
b AS (SELECT *, power(least(ret_1d, 0), 2) AS l0, CASE WHEN ret_1d IS NULL THEN NULL ELSE power(least(ret_1d, 0), 2) END AS loss FROM a)
SELECT symbol, trade_date, {r6('ret_1d')}, {r6('mom_5')}, {r6('mom_20')}, {r6('mom_60')}, {r6('mom_120')},
  {r6(roll_sql('stddev_samp(ret_1d)', 'ret_1d', 5, 3), 'vol_5')}, {r6(roll_sql('stddev_samp(ret_1d)', 'ret_1d', 20, 10), 'vol_20')}, {r6(roll_sql('stddev_samp(ret_1d)', 'ret_1d', 60, 30), 'vol_60')},
  {r6('sqrt(' + roll_sql('avg(loss)', 'loss', 20, 10) + ')', 'downside_vol_20')}, {r6('(high - low) / close', 'range_pct')}, {r6('(close - low) / nullif(high - low, 0)', 'close_location')} FROM b""")
def price_features(spark, d):
    names = ["ret_1d", "mom_5", "mom_20", "mom_60", "mom_120", "vol_5", "vol_20", "vol_60", "downside_vol_20", "range_pct", "close_location"]
    return rounded(ts.price_features(panel(spark, d)), "symbol", "trade_date", *names)


@query(f"""WITH {PANEL_SQL}, a AS (SELECT *, ln(1 + amount) AS la FROM panel), b AS (SELECT *, {roll_sql('avg(la)', 'la', 20, 10)} AS log_amount_20, {roll_sql('avg(turnover)', 'turnover', 20, 10)} AS turnover_20,
  ln(amount) AS size_log, CASE WHEN pb > 0 THEN 1 / pb END AS yield_pb FROM a)
SELECT symbol, trade_date, {r6('log_amount_20')}, {r6('turnover_20')}, {r6('size_log')}, {r6('yield_pb')}, {r6(pct_sql('(CASE WHEN symbol % 3 <> 0 THEN size_log END)'), 'size_log_rank')}, {r6(pct_sql('(CASE WHEN symbol % 3 <> 0 THEN yield_pb END)'), 'yield_pb_rank')} FROM b""")
def liquidity_style(spark, d):
    df = ts.liquidity_style(panel(spark, d), "amount", "turnover", "amount", ["pb"], F.col("symbol") % 3 != 0)
    return rounded(df, "symbol", "trade_date", "log_amount_20", "turnover_20", "size_log", "yield_pb", "size_log_rank", "yield_pb_rank")


@query(f"""WITH {PANEL_SQL}, cal AS (SELECT trade_date, row_number() OVER (ORDER BY trade_date) AS pos FROM (SELECT DISTINCT trade_date FROM panel)),
a AS (SELECT p.*, pos, pos - lag(pos) OVER h AS gap, lag(n_lines) OVER h AS nb, close / lag(close) OVER h - 1 AS r FROM panel p JOIN cal USING (trade_date) {H}),
b AS (SELECT *, CASE WHEN gap = 1 AND n_lines < 3 AND nb < 3 THEN r END AS adjacent_return FROM a)
SELECT symbol, trade_date, {r6('adjacent_return')}, {r6('avg(adjacent_return) OVER (PARTITION BY trade_date)', 'market_return')} FROM b""")
def adjacent_and_market_return(spark, d):
    df = ts.adjacent_returns(panel(spark, d).withColumn("tradable", F.col("n_lines") < 3), "close", "tradable")
    return rounded(ts.market_return(df, "adjacent_return"), "symbol", "trade_date", "adjacent_return", "market_return")


RET = f"ret AS (SELECT *, close / lag(close) OVER h - 1 AS r FROM panel {H}), mkt AS (SELECT *, avg(r) OVER (PARTITION BY trade_date) AS m FROM ret)"


def with_market(spark, d):
    df = panel(spark, d).withColumn("r", R.pct_change("close", pn.PANEL.history()))
    return ts.market_return(df, "r", "m")


BETA_W = "OVER (PARTITION BY symbol ORDER BY trade_date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)"


@query(f"""WITH {PANEL_SQL}, {RET}
SELECT symbol, trade_date, {r6(f'CASE WHEN count(r) {BETA_W} >= 40 THEN regr_slope(r, m) {BETA_W} END', 'beta_60')},
  {r6(f'CASE WHEN count(r) {BETA_W} >= 40 THEN sqrt(greatest(regr_syy(r, m) {BETA_W} - power(regr_sxy(r, m) {BETA_W}, 2) / regr_sxx(r, m) {BETA_W}, 0) / (count(r) {BETA_W} - 1)) END', 'resvol_60')} FROM mkt""")
def beta_and_residual_volatility(spark, d):
    df = ts.rolling_slope(with_market(spark, d), "r", "m", 60, 40, "beta_60")
    return rounded(ts.residual_volatility(df, "r", "m", 60, 40, "resvol_60"), "symbol", "trade_date", "beta_60", "resvol_60")


@query(f"""WITH {PANEL_SQL}, {RET}, cal AS (SELECT trade_date, row_number() OVER (ORDER BY trade_date) AS pos FROM (SELECT DISTINCT trade_date FROM panel)),
span AS (SELECT symbol, min(pos) AS a, max(pos) AS b FROM panel JOIN cal USING (trade_date) GROUP BY symbol),
grid AS (SELECT s.symbol, c.trade_date, k.r, k.m FROM span s JOIN cal c ON c.pos BETWEEN s.a AND s.b LEFT JOIN mkt k ON k.symbol = s.symbol AND k.trade_date = c.trade_date),
slopes AS (SELECT symbol, trade_date, CASE WHEN count(r) {BETA_W} >= 12 THEN regr_slope(r, m) {BETA_W} END AS s,
  CASE WHEN count(r) OVER w2 = 2 THEN sqrt(avg(power(least(r, 0), 2)) OVER w2) END AS down FROM (SELECT symbol, trade_date, r, CASE WHEN r IS NOT NULL THEN m END AS m FROM grid)
  WINDOW w2 AS (PARTITION BY symbol ORDER BY trade_date ROWS BETWEEN 1 PRECEDING AND CURRENT ROW))
SELECT p.symbol, p.trade_date, {r6('s', 'calendar_beta')}, {r6('down', 'downside_rms')} FROM panel p JOIN slopes USING (symbol, trade_date)""")
def calendar_windows(spark, d):
    df = ts.rolling_slope(with_market(spark, d), "r", "m", 60, 12, "calendar_beta", on_calendar=True)
    return rounded(ts.downside_rms(df, "r", 2, "downside_rms"), "symbol", "trade_date", "calendar_beta", "downside_rms")


@query(f"""WITH {PANEL_SQL}, {RET}, a AS (SELECT *, {roll_sql('stddev_samp(r)', 'r', 20, 15)} AS s, {roll_sql('stddev_samp(r)', 'r', 120, 80)} AS l FROM ret),
ind AS (SELECT trade_date, industry, avg(r) AS m FROM ret GROUP BY ALL), mom AS (SELECT *, m / nullif(lag(m, 20) OVER (PARTITION BY industry ORDER BY trade_date), 0) - 1 AS im FROM ind)
SELECT symbol, a.trade_date, {r6('-(s / nullif(l, 0))', 'vol_convergence')}, {r6('im', 'industry_momentum')} FROM a JOIN mom USING (trade_date, industry)""")
def volatility_and_industry_momentum(spark, d):
    df = panel(spark, d).withColumn("r", R.pct_change("close", pn.PANEL.history()))
    df = ts.volatility_convergence(df, "r", (20, 15), (120, 80), "vol_convergence")
    df = ts.industry_momentum(df, "r", "industry", 20, "industry_momentum")
    return rounded(df, "symbol", "trade_date", "vol_convergence", "industry_momentum")


Z = f"CASE WHEN {roll_sql('stddev_pop(volume)', 'volume', 60, 36)} > 0 THEN (volume - {roll_sql('avg(volume)', 'volume', 60, 36)}) / {roll_sql('stddev_pop(volume)', 'volume', 60, 36)} END"


@query(f"""WITH {PANEL_SQL}, z AS (SELECT *, {Z} AS z0 FROM panel), c AS (SELECT *, CASE WHEN z0 IS NULL THEN NULL ELSE least(greatest(z0, -8), 8) END AS z FROM z),
h AS (SELECT *, z * z * z - 3 * z AS h3, z * z * z * z - 6 * z * z + 3 AS h4 FROM c)
SELECT symbol, trade_date, {r6(f"-ln(1 + power({roll_sql('avg(h3)', 'h3', 60, 36)}, 2) / 6 + power({roll_sql('avg(h4)', 'h4', 60, 36)}, 2) / 24)", 'hermite_stability')} FROM h""")
def hermite_stability(spark, d):
    return rounded(ts.hermite_stability(panel(spark, d).select("symbol", "trade_date", "volume"), "volume"), "symbol", "trade_date", "hermite_stability")


@query(f"""WITH {PANEL_SQL}, t AS (SELECT *, greatest(high - low, abs(high - lag(close) OVER h), abs(low - lag(close) OVER h)) AS tr FROM panel {H})
SELECT symbol, trade_date, {r6('tr', 'true_range')}, {r6(roll_sql('avg(tr)', 'tr', 14, 14), 'atr')},
  {r6('CASE WHEN count(high) OVER w >= 20 THEN max(high) OVER w END', 'rolling_high')}, {r6(roll_sql('sum(close * volume)', 'close', 10, 10) + ' / ' + roll_sql('sum(volume)', 'volume', 10, 10), 'volume_weighted_cost')},
  {r6('volume / CASE WHEN count(volume) OVER w >= 5 THEN nullif(avg(volume) OVER w, 0) END', 'volume_ratio')} FROM t
WINDOW w AS (PARTITION BY symbol ORDER BY trade_date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)""")
def technical_indicators(spark, d):
    df = ts.rolling_high(ts.average_true_range(panel(spark, d)))
    df = ts.volume_ratio(ts.volume_weighted_cost(df, 10, "close", "volume", "volume_weighted_cost"), "volume")
    return rounded(df, "symbol", "trade_date", "true_range", "atr", "rolling_high", "volume_weighted_cost", "volume_ratio")


@query(f"""WITH {PANEL_SQL}, {RET}, a AS (SELECT *, {roll_sql('avg(close)', 'close', 10, 10)} AS sma_10 FROM ret)
SELECT symbol, trade_date, {r6('sma_10')}, {r6('sma_10 / lag(sma_10) OVER h - 1', 'sma_10_change')}, {r6('volume / ' + roll_sql('avg(volume)', 'volume', 10, 10), 'volume_sma_10_ratio')},
  {r6('close / lag(close, 10) OVER h - 1', 'ret_10')}, {r6(roll_sql('stddev_pop(r)', 'r', 10, 10), 'rv_10')} FROM a {H}""")
def moving_averages(spark, d):
    df = ts.moving_averages(panel(spark, d), "close", "volume", [10])
    return rounded(df, "symbol", "trade_date", "sma_10", "sma_10_change", "volume_sma_10_ratio", "ret_10", "rv_10")


@query(f"""WITH {PANEL_SQL}, z AS (SELECT *, CASE WHEN {roll_sql('stddev_pop(close)', 'close', 30, 30)} > 0 THEN (close - {roll_sql('avg(close)', 'close', 30, 30)}) / {roll_sql('stddev_pop(close)', 'close', 30, 30)} END AS z FROM panel),
c AS (SELECT symbol, trade_date, CASE WHEN z IS NULL THEN NULL ELSE greatest(z, 0) END AS u, CASE WHEN z IS NULL THEN NULL ELSE least(z, 0) END AS v FROM z),
s AS (SELECT symbol, trade_date, {roll_sql('sum(u)', 'u', 30, 30)} AS cusum_up, {roll_sql('sum(v)', 'v', 30, 30)} AS cusum_down FROM c)
SELECT symbol, trade_date, {r6('cusum_up')}, {r6('cusum_down')}, coalesce(greatest(cusum_up, -cusum_down) >= 3.0 * sqrt(30), false) AS cusum_break FROM s""")
def rolling_cusum(spark, d):
    return rounded(ts.rolling_cusum(panel(spark, d), "close", 30, 3.0), "symbol", "trade_date", "cusum_up", "cusum_down", "cusum_break")


@query(f"""WITH {PANEL_SQL}, q AS (SELECT *, quantile_cont(pb, 0.05) OVER d AS lo, quantile_cont(pb, 0.95) OVER d AS hi FROM panel WINDOW d AS (PARTITION BY trade_date)),
w AS (SELECT *, CASE WHEN pb IS NULL THEN NULL ELSE least(greatest(pb, lo), hi) END AS x FROM q)
SELECT symbol, trade_date, {r6('coalesce(CASE WHEN stddev_pop(x) OVER d > 0 THEN (x - avg(x) OVER d) / stddev_pop(x) OVER d END, 0)', 'pb')} FROM w WINDOW d AS (PARTITION BY trade_date)""")
def transform_zscore(spark, d):
    return rounded(cs.transform(panel(spark, d), ["pb"], "zscore", 0.05), "symbol", "trade_date", "pb")


@query(f"""WITH {PANEL_SQL}, m AS (SELECT *, median(pb) OVER (PARTITION BY trade_date) AS m FROM panel), s AS (SELECT *, median(abs(pb - m)) OVER (PARTITION BY trade_date) AS s FROM m)
SELECT symbol, trade_date, {r6('coalesce((pb - m) / nullif(s, 0), 0)', 'pb')} FROM s""")
def transform_robust(spark, d):
    return rounded(cs.transform(panel(spark, d), ["pb"], "robust"), "symbol", "trade_date", "pb")


@query(f"""WITH {PANEL_SQL} SELECT symbol, trade_date, {r6(pct_sql('pb', 'trade_date, industry') + ' - 0.5', 'pb')},
  CASE WHEN volume IS NOT NULL THEN dense_rank() OVER (PARTITION BY trade_date ORDER BY volume) - 1 END AS volume FROM panel""")
def transform_ranks(spark, d):
    df = cs.transform(panel(spark, d), ["pb"], "rank", groups=["industry"])
    return rounded(cs.transform(df, ["volume"], "rank_relevance"), "symbol", "trade_date", "pb", "volume")


@query(f"""WITH {PANEL_SQL}, w AS (SELECT *, CASE WHEN pb IS NOT NULL THEN close END AS y, CASE WHEN close IS NOT NULL THEN pb END AS x FROM panel)
SELECT symbol, trade_date, {r6('CASE WHEN y IS NOT NULL AND x IS NOT NULL AND count(x) OVER d >= 5 THEN close - 0.8 * coalesce(regr_slope(y, x) OVER d * (x - avg(x) OVER d), 0) ELSE close END', 'neutral')} FROM w WINDOW d AS (PARTITION BY trade_date)""")
def neutralize_one(spark, d):
    df = cs.neutralize(panel(spark, d), "close", ["pb"], 0.8, 5, "neutral")
    return rounded(df, "symbol", "trade_date", "neutral")


@query(None)
def neutralize_two(spark, d):
    return rounded(cs.neutralize(panel(spark, d), "close", ["pb", "volume"], 1.0, 6, "neutral"), "symbol", "trade_date", "neutral")


@query(f"""WITH {PANEL_SQL}, r AS (SELECT *, {pct_sql('close')} AS a, {pct_sql('pb')} AS b, {pct_sql('volume')} AS c FROM panel)
SELECT symbol, trade_date, {r6('coalesce(0.7 * a + 0.3 * (coalesce(b, 0) + coalesce(c, 0)) / nullif((b IS NOT NULL)::INT + (c IS NOT NULL)::INT, 0), a)', 'blend')} FROM r""")
def rank_blend(spark, d):
    return rounded(cs.rank_blend(panel(spark, d), "close", ["pb", "volume"], 0.3, "blend"), "symbol", "trade_date", "blend")


@query(f"""WITH {PANEL_SQL}, q AS (SELECT *, quantile_cont(close, 0.01) OVER d AS lo, quantile_cont(close, 0.99) OVER d AS hi FROM panel WINDOW d AS (PARTITION BY trade_date)),
w AS (SELECT *, least(greatest(close, lo), hi) AS x FROM q), n AS (SELECT *, x - avg(x) OVER (PARTITION BY trade_date, industry) AS y FROM w)
SELECT symbol, trade_date, {r6('CASE WHEN stddev_samp(y) OVER d > 0 THEN (y - avg(y) OVER d) / stddev_samp(y) OVER d END', 'close')} FROM n WHERE trade_date IN (SELECT trade_date FROM panel GROUP BY 1 HAVING count(*) > 12) WINDOW d AS (PARTITION BY trade_date)""")
def standardize_panel(spark, d):
    df = cs.standardize(panel(spark, d), ["close"], "industry").withColumn("n", F.count(F.lit(1)).over(R.by("trade_date")))
    return rounded(df.filter("n > 12"), "symbol", "trade_date", "close")


BOTTOM = "(rank() OVER (PARTITION BY trade_date ORDER BY {x} ASC NULLS LAST) + (count(*) OVER (PARTITION BY trade_date, {x}) - 1) / 2.0) / count(*) OVER (PARTITION BY trade_date)"


@query(f"""WITH {PANEL_SQL}, r AS (SELECT *, {BOTTOM.format(x='close')} AS a, {BOTTOM.format(x='pb')} AS b, {BOTTOM.format(x='volume')} AS c FROM panel)
SELECT symbol, trade_date, {r6('a', 'close_base')}, {r6('0.75 * a + 0.25 * (b + c) / 2', 'close_fresh')} FROM r""")
def freshness_overlay(spark, d):
    return rounded(cs.freshness_overlay(panel(spark, d), "close", ["pb", "volume"], 0.25), "symbol", "trade_date", "close_base", "close_fresh")


@query(f"""WITH {PANEL_SQL}, r AS (SELECT *, {pct_sql('close')} AS a, {pct_sql('(-pb)')} AS b FROM panel), s AS (SELECT *, round((2 * a + coalesce(b, 0)) / (2 + (b IS NOT NULL)::INT), 9) AS score, (2 + (b IS NOT NULL)::INT) / 3.0 AS cov FROM r),
t AS (SELECT *, quantile_cont(CASE WHEN cov >= 0.9 THEN score END, 0.8) OVER (PARTITION BY trade_date) AS cut FROM s)
SELECT symbol, trade_date, {r6('score')}, {r6('cov', 'score_coverage')}, coalesce(cov >= 0.9 AND score >= cut, false) AS is_candidate FROM t""")
def forecast_score_and_candidates(spark, d):
    df = cs.weighted_rank_score(panel(spark, d), [("close", 2.0, True), ("pb", 1.0, False)]).withColumn("score", F.round("score", 9))
    return rounded(cs.candidates(df, "score", "score_coverage", 0.9, 0.2), "symbol", "trade_date", "score", "score_coverage", "is_candidate")


@query(f"""WITH {PANEL_SQL} SELECT symbol, trade_date, {r6('(0.6 * close + 0.4 * coalesce(pb, 0)) / (0.6 + CASE WHEN pb IS NULL THEN 0 ELSE 0.4 END)', 'fused_score')}, {r6('0.6 + CASE WHEN pb IS NULL THEN 0 ELSE 0.4 END', 'fused_score_coverage')} FROM panel""")
def fused_signal(spark, d):
    return rounded(cs.fused(panel(spark, d), {"close": 0.6, "pb": 0.4}), "symbol", "trade_date", "fused_score", "fused_score_coverage")


@query(f"""WITH {PANEL_SQL}, a AS (SELECT *, CASE WHEN pb IS NOT NULL THEN CASE WHEN count(pb) OVER d = 1 THEN 0 ELSE 2 * ((rank() OVER (PARTITION BY trade_date ORDER BY pb ASC NULLS LAST) + (count(pb) OVER (PARTITION BY trade_date, pb) - 1) / 2.0) - 1) / nullif(count(pb) OVER d - 1, 0) - 1 END END AS p,
  CASE WHEN stddev_pop(volume) OVER d > 0 THEN least(greatest((volume - avg(volume) OVER d) / stddev_pop(volume) OVER d, -3), 3) / 3 END AS v FROM panel WINDOW d AS (PARTITION BY trade_date))
SELECT symbol, trade_date, {r6('least(greatest(CASE industry WHEN 0 THEN 0.5 WHEN 1 THEN -0.25 ELSE 0.1 END + coalesce(-0.4 * p, 0) + coalesce(0.3 * v, 0), -1), 1)', 'exposure')} FROM a""")
def company_exposures(spark, d):
    df = cs.exposures(panel(spark, d), "industry", {"0": 0.5, "1": -0.25}, [("pb", -1.0, 0.4, "rank_pct"), ("volume", 1.0, 0.3, "zscore")], -1.0, 1.0, 0.1)
    return rounded(df, "symbol", "trade_date", "exposure")


@query(f"""WITH {PANEL_SQL}, c AS (SELECT *, row_number() OVER (PARTITION BY trade_date ORDER BY close DESC, symbol) AS r, count(close) OVER (PARTITION BY trade_date) AS n FROM panel)
SELECT symbol, trade_date, {r6('r / n', 'rank_share')}, r / n <= 0.1 AS enters, symbol % 4 = 0 AND r / n <= 0.25 AS stays FROM c""")
def candidate_buffer(spark, d):
    df = panel(spark, d)
    held = df.filter("symbol % 4 = 0").select("symbol").distinct()
    return rounded(cs.buffered(df, "close", held, 0.1, 0.25), "symbol", "trade_date", "rank_share", "enters", "stays")


@query(f"""WITH {PANEL_SQL} SELECT symbol, trade_date, row_number() OVER (PARTITION BY trade_date ORDER BY close DESC, symbol) AS rank FROM panel QUALIFY rank <= 3""")
def top_three(spark, d):
    return rounded(cs.top_k(panel(spark, d), "close", 3), "symbol", "trade_date", "rank")


@query(f"""WITH {PANEL_SQL} SELECT symbol, trade_date, {r6('coalesce(pb, median(pb) OVER (PARTITION BY trade_date))', 'pb')}, CAST(pb IS NULL AS BIGINT) AS pb_missing FROM panel""")
def missing_fill(spark, d):
    return rounded(pn.fill_missing(panel(spark, d), ["pb"], "median", True), "symbol", "trade_date", "pb", "pb_missing")


@query(f"""WITH {PANEL_SQL}, e AS (SELECT max(trade_date) AS trade_date FROM panel GROUP BY date_trunc('week', trade_date + 2)) SELECT symbol, p.trade_date, {r6('close')} FROM panel p JOIN e USING (trade_date)""")
def weekly_sample(spark, d):
    df = panel(spark, d)
    return rounded(pn.on_dates(df, pn.period_ends(df, "W-FRI")), "symbol", "trade_date", "close")


@query("""SELECT CAST(s_suppkey AS BIGINT) AS s_suppkey, coalesce(nullif(trim(CASE WHEN s_suppkey % 2 = 0 THEN ' ' ELSE s_name END), ''), nullif(trim(s_name || '.SH'), '')) AS symbol, coalesce(try_cast(f AS DOUBLE) = 0, false) OR lower(trim(f)) IN ('false', 'f', 'no', 'n') AS is_false
FROM (SELECT *, CASE s_suppkey % 5 WHEN 0 THEN '0' WHEN 1 THEN ' F ' WHEN 2 THEN 'no' WHEN 3 THEN 'true' ELSE '' END AS f FROM supplier)""")
def symbols_and_flags(spark, d):
    s = table(spark, d, "supplier")
    k = F.col("s_suppkey") % 5
    flag = F.when(k == 0, "0").when(k == 1, " F ").when(k == 2, "no").when(k == 3, "true").otherwise("")
    s = s.withColumn("a", F.when(F.col("s_suppkey") % 2 == 0, " ").otherwise(F.col("s_name"))).withColumn("b", F.concat("s_name", F.lit(".SH"))).withColumn("f", flag)
    return s.select(F.col("s_suppkey").cast("long").alias("s_suppkey"), pn.resolve_symbol(["a", "b"]).alias("symbol"), pn.known_false("f").alias("is_false"))


for _name, _f in {
    "rsi": lambda df: ts.rsi(df, "close"),
    "macd": lambda df: ts.macd(df, "close"),
    "ewm_volatility": lambda df: ts.ewm_volatility(df, "close", 20),
    "fractional_difference": lambda df: ts.fractional_difference(df, "close", 0.4, 1e-3),
    "stationarity": lambda df: ts.stationarity(df, "close"),
    "sup_adf": lambda df: ts.sup_adf(df, "close", 40),
}.items():

    def _run(spark, d, f=_f):
        return f(panel(spark, d).select("symbol", "trade_date", "close"))

    _run.__name__ = _name
    query(None)(_run)


@query(f"""WITH RECURSIVE {PANEL_SQL}, p AS MATERIALIZED (SELECT symbol, trade_date, close - lag(close) OVER w AS x, row_number() OVER w AS n FROM panel WINDOW w AS (PARTITION BY symbol ORDER BY trade_date)),
s AS (SELECT symbol, trade_date, n, CAST(0 AS DOUBLE) AS up, CAST(0 AS DOUBLE) AS down, 0 AS direction, CAST(0 AS DOUBLE) AS statistic FROM p WHERE n = 1
  UNION ALL SELECT symbol, trade_date, n, CASE WHEN u > 500 THEN 0 ELSE u END, CASE WHEN u <= 500 AND d < -500 THEN 0 ELSE d END, CASE WHEN u > 500 THEN 1 WHEN d < -500 THEN -1 ELSE 0 END, CASE WHEN u > 500 THEN u ELSE d END
  FROM (SELECT p.symbol, p.trade_date, p.n, greatest(0, s.up + p.x - 5) AS u, least(0, s.down + p.x + 5) AS d FROM s JOIN p ON p.symbol = s.symbol AND p.n = s.n + 1))
SELECT symbol, trade_date, direction, {r6('statistic')} FROM s WHERE direction <> 0""")
def symmetric_cusum(spark, d):
    moves = panel(spark, d).withColumn("x", F.col("close") - F.lag("close").over(pn.PANEL.history()))
    return rounded(ts.symmetric_cusum(moves, "x", 500.0, 5.0), "symbol", "trade_date", "direction", "statistic")
