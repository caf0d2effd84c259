"""Queries of factor selection, regimes, turnover and holdings with a memory."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspark.operators import cross_section as cs
from loomspark.operators import diagnostics as dg
from loomspark.operators import ensembles
from loomspark.plans.diagnostic_queries import FWD, W10, forward, ranked_sql
from loomspark.plans.registry import PANEL_SQL, corr_sql, panel, query, r6, rounded

FACTORS = ["pb", "turnover", "volume"]
LONG3 = "l AS (SELECT symbol, trade_date, fwd, factor, value FROM (SELECT symbol, trade_date, fwd, pb, volume, turnover FROM f) UNPIVOT INCLUDE NULLS (value FOR factor IN (pb, volume, turnover)))"
CORR_SQL = """prs AS (SELECT trade_date, 'pb' AS left_factor, 'turnover' AS right_factor, pb AS x, turnover AS y FROM panel UNION ALL SELECT trade_date, 'pb', 'volume', pb, volume FROM panel UNION ALL SELECT trade_date, 'turnover', 'volume', turnover, volume FROM panel),
prd AS (SELECT trade_date, left_factor, right_factor, count(x + y) AS n, coalesce(sum(x) FILTER (y IS NOT NULL), 0) AS x, coalesce(sum(y) FILTER (x IS NOT NULL), 0) AS y, coalesce(sum(x * x) FILTER (y IS NOT NULL), 0) AS xx, coalesce(sum(y * y) FILTER (x IS NOT NULL), 0) AS yy, coalesce(sum(x * y), 0) AS xy FROM prs GROUP BY ALL),
prw AS (SELECT trade_date, left_factor, right_factor, coalesce(sum(n) OVER w, 0) AS n, sum(x) OVER w AS x, sum(y) OVER w AS y, sum(xx) OVER w AS xx, sum(yy) OVER w AS yy, sum(xy) OVER w AS xy FROM prd WINDOW w AS (PARTITION BY left_factor, right_factor ORDER BY trade_date ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING)),
correlations AS (SELECT trade_date, left_factor, right_factor, CAST(n AS BIGINT) AS n_obs, CASE WHEN n * xx - x * x > 1e-12 AND n * yy - y * y > 1e-12 THEN (n * xy - x * y) / sqrt((n * xx - x * x) * (n * yy - y * y)) END AS corr FROM prw)"""


@query(f"WITH {PANEL_SQL}, {CORR_SQL} SELECT trade_date, left_factor, right_factor, n_obs, {r6('corr')} FROM correlations")
def rolling_factor_correlations(spark, d):
    return rounded(ensembles.rolling_correlations(panel(spark, d), FACTORS, 60), "trade_date", "left_factor", "right_factor", "n_obs", "corr")


@query(f"""WITH RECURSIVE {FWD}, {CORR_SQL}, {LONG3}, {ranked_sql('value', 'fwd', 'l', 'trade_date, factor')}, i AS (SELECT trade_date, factor, CASE WHEN count(a) >= 2 THEN {corr_sql('a', 'b')} END AS c FROM rk GROUP BY 1, 2), w AS (SELECT *, CASE WHEN count(c) {W10} >= 6 THEN avg(c) {W10} END AS m, CASE WHEN count(c) {W10} >= 6 THEN stddev_samp(c) {W10} END AS s FROM i),
g AS (SELECT trade_date, factor, lag(m) OVER h AS strength, lag(CASE WHEN s > 1e-9 THEN m / s END) OVER h AS icir FROM w WINDOW h AS (PARTITION BY factor ORDER BY trade_date)),
o AS (SELECT *, CASE WHEN icir IS NULL THEN 'insufficient_history' WHEN icir < -0.1 THEN 'icir_below_threshold' WHEN strength < -0.5 THEN 'strength_below_threshold' END AS why, row_number() OVER (PARTITION BY trade_date ORDER BY strength DESC NULLS LAST, factor) AS place FROM g),
q AS (SELECT *, count(*) FILTER (why IS NULL) OVER (PARTITION BY trade_date) = 0 AS none FROM o), cd AS (SELECT *, coalesce(why IS NULL OR (none AND strength IS NOT NULL AND place <= 1), false) AS candidate FROM q),
hi AS (SELECT trade_date, left_factor AS a, right_factor AS b FROM correlations WHERE abs(corr) > 0.03 UNION ALL SELECT trade_date, right_factor, left_factor FROM correlations WHERE abs(corr) > 0.03),
pick AS (SELECT trade_date, 0 AS place, [NULL::VARCHAR][2:] AS done FROM (SELECT DISTINCT trade_date FROM cd) UNION ALL
  SELECT p.trade_date, p.place + 1, CASE WHEN c.candidate AND NOT EXISTS (SELECT 1 FROM hi WHERE hi.trade_date = p.trade_date AND hi.a = c.factor AND list_contains(p.done, hi.b)) THEN list_append(p.done, c.factor) ELSE p.done END FROM pick p JOIN cd c ON c.trade_date = p.trade_date AND c.place = p.place + 1),
fin AS (SELECT trade_date, done FROM pick QUALIFY row_number() OVER (PARTITION BY trade_date ORDER BY place DESC) = 1)
SELECT trade_date, factor, list_contains(done, factor) AS selected, CASE WHEN list_contains(done, factor) THEN '' WHEN candidate THEN 'correlation_filtered' ELSE coalesce(why, '') END AS reason FROM cd JOIN fin USING (trade_date)""")
def factor_selection(spark, d):
    df = forward(spark, d)
    ics = dg.factor_dates(df, FACTORS, "fwd")
    stats = dg.rolling_factor_stats(ics, 10, 6).select("trade_date", "factor", F.col("rolling_ic").alias("strength"), F.col("rolling_icir").alias("icir"))
    return ensembles.select_factors(stats, ensembles.rolling_correlations(df, FACTORS, 60), [("icir", "icir_below_threshold", -0.1)], 0.03, least_strength=-0.5)


#: Quantiles between equal values may be a little off them here.
#: Returns of a factor: its rank correlation with what follows. Regimes: the mean turnover, and the rows of the date.
REGIME_SQL = f"""{FWD}, {LONG3}, {ranked_sql('value', 'fwd', 'l', 'trade_date, factor')}, ret AS (SELECT trade_date, factor, CASE WHEN count(a) >= 2 THEN {corr_sql('a', 'b')} END AS r FROM rk GROUP BY 1, 2),
cal AS (SELECT trade_date, row_number() OVER (ORDER BY trade_date) AS pos FROM (SELECT DISTINCT trade_date FROM f)),
feat AS (SELECT trade_date, 'mean_turnover' AS feature, CASE WHEN count(*) % 7 <> 0 THEN round(avg(turnover), 6) END AS v FROM f GROUP BY 1 UNION ALL SELECT trade_date, 'rows', CAST(count(*) AS DOUBLE) FROM f GROUP BY 1),
fp AS (SELECT feature, pos, v FROM feat JOIN cal USING (trade_date)),
cut AS (SELECT a.feature, a.pos, a.v, quantile_cont(b.v, 1.0 / 3) AS low, quantile_cont(b.v, 2.0 / 3) AS high FROM fp a JOIN fp b ON a.feature = b.feature AND b.pos BETWEEN a.pos - 24 AND a.pos - 1 AND b.v IS NOT NULL WHERE a.pos > 24 AND a.v IS NOT NULL GROUP BY ALL HAVING count(*) >= 8),
lk AS (SELECT c.feature, c.pos, b.pos AS past FROM cut c JOIN fp b ON b.feature = c.feature AND b.pos BETWEEN c.pos - 24 AND c.pos - 1 AND CASE WHEN c.v <= c.low + 1e-12 THEN b.v <= c.low + 1e-12 WHEN c.v >= c.high - 1e-12 THEN b.v >= c.high - 1e-12 ELSE b.v > c.low + 1e-12 AND b.v < c.high - 1e-12 END),
m1 AS (SELECT lk.pos, lk.feature, ret.factor, avg(r) AS m FROM lk JOIN cal ON cal.pos = lk.past JOIN ret USING (trade_date) GROUP BY 1, 2, 3), m2 AS (SELECT pos, factor, avg(m) AS m FROM m1 GROUP BY 1, 2),
sc AS (SELECT trade_date, ret.factor, CASE WHEN count(m2.m) OVER (PARTITION BY trade_date) > 0 THEN m2.m ELSE 0 END AS m FROM ret JOIN cal USING (trade_date) LEFT JOIN m2 ON m2.pos = cal.pos AND m2.factor = ret.factor)"""


@query(f"WITH {REGIME_SQL} SELECT trade_date, factor, {r6('coalesce(CASE WHEN stddev_pop(m) OVER d > 1e-12 THEN (m - avg(m) OVER d) / stddev_pop(m) OVER d END, 0)', 'regime_score')} FROM sc WINDOW d AS (PARTITION BY trade_date)")
def regime_scores(spark, d):
    df = forward(spark, d)
    returns = dg.factor_dates(df, FACTORS, "fwd").select("trade_date", "factor", F.col("rank_ic").alias("value"))
    days = df.groupBy("trade_date").agg(F.when(F.count(F.lit(1)) % 7 != 0, F.round(F.avg("turnover"), 6)).alias("mean_turnover"), F.count(F.lit(1)).cast("double").alias("rows"))
    features = days.unpivot(["trade_date"], ["mean_turnover", "rows"], "feature", "value")
    return rounded(ensembles.regime_scores(returns, features, 24), "trade_date", "factor", "regime_score")


HELD_SQL = f"""{PANEL_SQL}, near AS (SELECT symbol, trade_date, row_number() OVER (PARTITION BY trade_date ORDER BY close DESC, symbol) AS rank FROM panel QUALIFY rank <= 6),
dl AS (SELECT row_number() OVER (ORDER BY trade_date) AS i, trade_date, list(symbol ORDER BY rank) AS names FROM near GROUP BY trade_date),
hold AS (SELECT CAST(0 AS BIGINT) AS i, [NULL::BIGINT][2:] AS held, [NULL::BIGINT][2:] AS before UNION ALL
  SELECT dl.i, list_concat(list_filter(names, lambda x: list_contains(held, x))[:3], list_filter(names, lambda x: NOT list_contains(held, x))[:3 - least(3, len(list_filter(names, lambda x: list_contains(held, x))))]), held FROM hold JOIN dl ON dl.i = hold.i + 1)"""


@query(f"WITH RECURSIVE {HELD_SQL} SELECT near.trade_date, symbol, CAST(rank AS BIGINT) AS rank, list_contains(before, symbol) AS kept FROM hold JOIN dl USING (i) JOIN near ON near.trade_date = dl.trade_date AND list_contains(held, symbol)")
def held_with_buffer(spark, d):
    return rounded(ensembles.held_with_buffer(panel(spark, d), "close", 3, 6), "trade_date", "symbol", "rank", "kept")


@query(f"""WITH RECURSIVE {PANEL_SQL}, dn AS (SELECT trade_date, row_number() OVER (ORDER BY trade_date) AS i FROM (SELECT DISTINCT trade_date FROM panel)),
best AS (SELECT i, trade_date, symbol, close FROM panel JOIN dn USING (trade_date) QUALIFY row_number() OVER (PARTITION BY trade_date ORDER BY close DESC, symbol) <= 5), tg AS (SELECT i, symbol, close / sum(close) OVER (PARTITION BY i) AS w FROM best),
st AS (SELECT CAST(0 AS BIGINT) AS i, CAST(-1 AS BIGINT) AS symbol, CAST(0 AS DOUBLE) AS w, CAST(0 AS DOUBLE) AS turnover UNION ALL
  SELECT i, symbol, w / sum(w) OVER (), turnover FROM (
    SELECT i, symbol, turnover, CASE WHEN held > 0 AND turnover > 0.4 THEN greatest(0, a + (b - a) * 0.4 / turnover) ELSE b END AS w FROM (
      SELECT *, sum(a) OVER () AS held, sum(abs(b - a)) OVER () AS turnover FROM (
        SELECT max(i) AS i, symbol, sum(a) AS a, sum(b) AS b FROM (SELECT i + 1 AS i, symbol, w AS a, 0 AS b FROM st UNION ALL SELECT tg.i, tg.symbol, 0, tg.w FROM tg WHERE tg.i = (SELECT max(i) + 1 FROM st)) GROUP BY symbol)
      WHERE i <= (SELECT max(i) FROM dn))) WHERE w >= 1e-12 OR symbol = -1)
SELECT trade_date, symbol, {r6('w', 'weight')}, {r6('turnover')} FROM st JOIN dn USING (i) WHERE symbol >= 0 AND w >= 1e-12""")
def turnover_budget(spark, d):
    best = cs.top_k(panel(spark, d), "close", 5)
    total = F.sum("close").over(ensembles.R.by("trade_date"))
    return rounded(ensembles.turnover_budget(best.withColumn("target", F.col("close") / total), "target", 0.4), "trade_date", "symbol", "weight", "turnover")
