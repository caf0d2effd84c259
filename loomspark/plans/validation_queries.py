"""Queries of combinatorial purged cross-validation and of calibration."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomspark.operators import calibration, cpcv
from loomspark.plans.diagnostic_queries import FWD, SERIES_SQL, forward, ranked_sql, series
from loomspark.plans.registry import PANEL_SQL, by_date, corr_sql, panel, query, r6, rounded
from loomspark.sources.checkpoints import through_table

PLAN = cpcv.Plan(6, 2, embargo_days=10)

#: Labels last from the next date to the fifth after it; each of 15 splits against each date, by all tested dates.
ROLES_SQL = """days AS (SELECT trade_date, ntile(6) OVER o - 1 AS g, coalesce(lead(trade_date) OVER o, trade_date) AS a, coalesce(lead(trade_date, 5) OVER o, max(trade_date) OVER ()) AS b FROM (SELECT DISTINCT trade_date FROM panel) WINDOW o AS (ORDER BY trade_date)),
combos AS (SELECT CAST(row_number() OVER (ORDER BY x, y) AS BIGINT) AS split_id, x, y FROM range(6) t(x), range(6) u(y) WHERE x < y),
spans AS (SELECT g, a, b FROM days),
roles AS (SELECT split_id, x, y, trade_date, CASE WHEN g IN (x, y) THEN 'test'
  WHEN EXISTS (SELECT 1 FROM spans t WHERE t.g IN (x, y) AND t.a <= d.b AND d.a <= t.b) THEN 'purged'
  WHEN EXISTS (SELECT 1 FROM spans t WHERE t.g IN (x, y) AND t.b < d.trade_date AND d.trade_date <= t.b + 10) THEN 'embargoed' ELSE 'train' END AS role FROM combos, days d)"""
#: In order, a split goes to the first of five paths that tests neither of its groups.
PATHS_SQL = """chosen AS (SELECT 0 AS i, [0, 0, 0, 0, 0] AS covered, CAST(NULL AS INT) AS path UNION ALL
  SELECT i + 1, list_transform(covered, lambda c, k: CASE WHEN k = p THEN c | m ELSE c END), p
  FROM (SELECT i, covered, m, list_position(list_transform(covered, lambda c: c & m = 0), true) AS p FROM chosen JOIN (SELECT split_id, CAST((1 << x) | (1 << y) AS INT) AS m FROM combos) ON split_id = i + 1)),
paths AS (SELECT CAST(i AS BIGINT) AS split_id, CAST(path AS BIGINT) AS path_id FROM chosen WHERE path > 0),
tested AS (SELECT path_id, split_id, trade_date FROM roles JOIN paths USING (split_id) WHERE role = 'test')"""


def performance_sql(value: str, source: str, per_year: float) -> str:
    return f"""nav AS (SELECT *, exp(sum(ln(1 + {value})) OVER (PARTITION BY path_id ORDER BY trade_date)) AS nav FROM {source} WHERE {value} IS NOT NULL),
down AS (SELECT *, nav / greatest(max(nav) OVER (PARTITION BY path_id ORDER BY trade_date), 1) - 1 AS down FROM nav),
performance AS (SELECT path_id, count(*) AS observations, exp(sum(ln(1 + {value}))) - 1 AS total_return, exp(sum(ln(1 + {value})) * {per_year} / count(*)) - 1 AS ann_return, stddev_samp({value}) * sqrt({per_year}) AS ann_vol,
  avg({value}) / nullif(stddev_samp({value}), 0) * sqrt({per_year}) AS sharpe, min(down) AS max_drawdown FROM down GROUP BY 1)"""


def dates(df):
    order = Window.orderBy("trade_date")  # one row a date
    days = df.select("trade_date").distinct()
    last = F.max("trade_date").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return days.select("trade_date", F.coalesce(F.lead("trade_date").over(order), "trade_date").alias("label_start"), F.coalesce(F.lead("trade_date", 5).over(order), last).alias("label_end"))


@query(f"WITH {PANEL_SQL}, {ROLES_SQL} SELECT split_id, CAST(x AS VARCHAR) || '|' || CAST(y AS VARCHAR) AS test_groups, count(*) FILTER (role = 'test') AS test_dates, count(*) FILTER (role = 'train') AS train_dates, count(*) FILTER (role = 'purged') AS purged_dates, count(*) FILTER (role = 'embargoed') AS embargoed_dates, 'event_window' AS purge_mode, 'ok' AS status FROM roles GROUP BY split_id, x, y")
def cpcv_splits(spark, d):
    return cpcv.splits(cpcv.roles(dates(panel(spark, d)), PLAN), PLAN)


#: A thousandth of the panel's returns, which are too large to be compounded over years.
SMALL = FWD.replace("/ close - 1 END AS fwd", "/ close - 1 END * 0.001 AS fwd")
FITS_SQL = """sums AS (SELECT trade_date, count(*) AS n, sum(pb) AS x, sum(turnover) AS y, sum(fwd) AS t, sum(pb * pb) AS xx, sum(pb * turnover) AS xy, sum(turnover * turnover) AS yy, sum(pb * fwd) AS xt, sum(turnover * fwd) AS yt FROM f WHERE pb IS NOT NULL AND turnover IS NOT NULL AND fwd IS NOT NULL GROUP BY 1),
total AS (SELECT split_id, sum(n) AS n, sum(x) AS x, sum(y) AS y, sum(t) AS t, sum(xx) - sum(x) * sum(x) / sum(n) + 0.1 AS a, sum(xy) - sum(x) * sum(y) / sum(n) AS b, sum(yy) - sum(y) * sum(y) / sum(n) + 0.1 AS c, sum(xt) - sum(x) * sum(t) / sum(n) AS p, sum(yt) - sum(y) * sum(t) / sum(n) AS q FROM (SELECT split_id, trade_date FROM roles WHERE role = 'train') JOIN sums USING (trade_date) GROUP BY 1),
slopes AS (SELECT *, (p * c - q * b) / (a * c - b * b) AS b1, (q * a - p * b) / (a * c - b * b) AS b2 FROM total),
fits AS (SELECT split_id, n, (t - b1 * x - b2 * y) / n AS b0, b1, b2 FROM slopes)"""


@query(f"WITH {FWD}, {ROLES_SQL}, {FITS_SQL} SELECT split_id, CAST(n AS BIGINT) AS n, {r6('b0', 'intercept')}, {r6('b1', 'pb')}, {r6('b2', 'turnover')} FROM fits")
def cpcv_ridge_fits(spark, d):
    df = forward(spark, d)
    fits = cpcv.ridge_of_splits(df, cpcv.roles(dates(df), PLAN), ["pb", "turnover"], "fwd", 0.1)
    return rounded(fits.withColumn("pb", F.element_at("coefficients", 1)).withColumn("turnover", F.element_at("coefficients", 2)), "split_id", "n", "intercept", "pb", "turnover")


AUDIT_SQL = f"""RECURSIVE {SMALL}, {ROLES_SQL}, {PATHS_SQL}, {FITS_SQL}, s AS (SELECT path_id, trade_date, symbol, round(b0 + b1 * pb + b2 * turnover, 13) AS pred, fwd FROM f JOIN tested USING (trade_date) JOIN fits USING (split_id) WHERE pb IS NOT NULL AND turnover IS NOT NULL),
{ranked_sql('pred', 'fwd', 's', 'path_id, trade_date')}, ic AS (SELECT path_id, trade_date, {corr_sql('a', 'b')} AS ic FROM rk GROUP BY 1, 2 HAVING count(DISTINCT y) >= 2 AND {corr_sql('a', 'b')} IS NOT NULL),
ics AS (SELECT path_id, avg(ic) AS ic_mean, avg(ic) / nullif(stddev_pop(ic), 0) AS ic_ir FROM ic GROUP BY 1),
r AS (SELECT *, count(*) OVER (PARTITION BY path_id, trade_date) AS n, row_number() OVER (PARTITION BY path_id, trade_date ORDER BY pred, symbol) AS k FROM s WHERE fwd IS NOT NULL),
b AS (SELECT *, greatest(CAST(ceil((k - 1) * 5.0 / nullif(n - 1, 0)) AS BIGINT) - 1, 0) AS q FROM r WHERE n >= 5),
u AS (SELECT path_id, trade_date, avg(fwd) FILTER (q = 4) AS top, avg(fwd) FILTER (q = 4) - avg(fwd) FILTER (q = 0) AS long_short FROM b GROUP BY 1, 2),
{performance_sql('top', 'u', 252)}, ls AS (SELECT path_id, avg(long_short) AS long_short FROM u GROUP BY 1),
spans2 AS (SELECT path_id, list_sort(list_distinct(list(split_id))) AS ids, min(trade_date) AS test_start, max(trade_date) AS test_end FROM tested GROUP BY 1),
audit AS (SELECT * FROM performance JOIN ls USING (path_id) LEFT JOIN ics USING (path_id) JOIN spans2 USING (path_id))"""


def ridge_audit(spark, d):
    """As cpcv.audit, with predictions rounded so that ties do not depend on how sums were added up."""
    used = forward(spark, d).select("symbol", "trade_date", "pb", "turnover", (F.col("fwd") * 0.001).alias("fwd"))
    df = through_table(used, "returns")  # read by dates, fits and paths
    found = through_table(cpcv.roles(dates(df), PLAN), "roles")
    paths = cpcv.tested(found, PLAN)
    fits = through_table(cpcv.ridge_of_splits(df, found, ["pb", "turnover"], "fwd", 0.1), "fits")
    scored = cpcv.scores(by_date(spark, d, df), paths, fits, ["pb", "turnover"], "fwd")
    return cpcv.path_results(scored.withColumn("pred", F.round("pred", 13)), paths)


@query(f"WITH {AUDIT_SQL} SELECT path_id, array_to_string(ids, '|') AS split_ids, test_start, test_end, observations, {r6('total_return')}, {r6('ann_return')}, {r6('ann_vol')}, {r6('sharpe')}, {r6('max_drawdown')}, {r6('long_short')}, {r6('ic_mean')}, {r6('ic_ir')} FROM audit")
def cpcv_ridge_paths(spark, d):
    return rounded(ridge_audit(spark, d), "path_id", "split_ids", "test_start", "test_end", "observations", "total_return", "ann_return", "ann_vol", "sharpe", "max_drawdown", "long_short", "ic_mean", "ic_ir")


@query(f"WITH {AUDIT_SQL} SELECT count(*) AS valid_path_count, {r6('avg(sharpe)', 'sharpe_mean')}, {r6('quantile_cont(sharpe, 0.5)', 'sharpe_median')}, {r6('quantile_cont(sharpe, 0.25)', 'sharpe_p25')}, {r6('quantile_cont(sharpe, 0.1)', 'sharpe_p10')}, {r6('min(sharpe)', 'sharpe_min')}, {r6('avg(CAST(sharpe > 0 AS INT))', 'positive_sharpe_ratio')}, {r6('quantile_cont(ic_mean, 0.5)', 'ic_median')}, {r6('quantile_cont(long_short, 0.5)', 'long_short_median')}, {r6('quantile_cont(abs(max_drawdown), 0.1)', 'max_drawdown_p10')} FROM audit")
def cpcv_summary(spark, d):
    return rounded(cpcv.summary(ridge_audit(spark, d)), "valid_path_count", "sharpe_mean", "sharpe_median", "sharpe_p25", "sharpe_p10", "sharpe_min", "positive_sharpe_ratio", "ic_median", "long_short_median", "max_drawdown_p10")


PERIODS_SQL = f"""p0 AS (SELECT trade_date, coalesce(lead(trade_date) OVER (ORDER BY trade_date), trade_date) AS a, coalesce(lead(trade_date, 5) OVER (ORDER BY trade_date), max(trade_date) OVER ()) AS b, x AS net_return, y AS benchmark, abs(x) * 2 AS turnover, abs(x) / 10 AS total_cost FROM s)"""


@query(f"""WITH RECURSIVE {PANEL_SQL}, {SERIES_SQL}, {ROLES_SQL}, {PATHS_SQL}, {PERIODS_SQL}, u AS (SELECT path_id, split_id, trade_date, net_return, benchmark, turnover, total_cost FROM tested JOIN p0 USING (trade_date)), {performance_sql('net_return', 'u', 252)},
c AS (SELECT path_id, avg(c) AS avg_cost_drag FROM (SELECT path_id, split_id, avg(total_cost) AS c FROM u GROUP BY 1, 2) GROUP BY 1), t AS (SELECT path_id, avg(turnover) AS avg_turnover FROM u GROUP BY 1),
act AS (SELECT path_id, exp(sum(ln(1 + net_return - benchmark))) - 1 AS active_total_return, stddev_samp(net_return - benchmark) * sqrt(252) AS tracking_error, avg(net_return - benchmark) * 252 / (stddev_samp(net_return - benchmark) * sqrt(252)) AS information_ratio FROM u WHERE benchmark IS NOT NULL GROUP BY 1)
SELECT path_id, observations, {r6('total_return')}, {r6('ann_return')}, {r6('ann_vol')}, {r6('sharpe')}, {r6('max_drawdown')}, {r6('avg_turnover')}, {r6('avg_cost_drag')}, {r6('active_total_return')}, {r6('tracking_error')}, {r6('information_ratio')} FROM performance JOIN c USING (path_id) JOIN t USING (path_id) LEFT JOIN act USING (path_id)""")
def cpcv_frozen_paths(spark, d):
    rows = series(spark, d)
    windows = dates(rows).withColumnsRenamed({"label_start": "entry_date", "label_end": "exit_date"})
    periods = rows.join(windows, "trade_date").select(F.col("trade_date").alias("rebalance_date"), "entry_date", "exit_date", F.col("x").alias("net_return"), F.col("y").alias("benchmark"), (F.abs("x") * 2).alias("turnover"), (F.abs("x") / 10).alias("total_cost"))
    out = cpcv.frozen_audit(periods, PLAN, 252.0, benchmark="benchmark")
    return rounded(out, "path_id", "observations", "total_return", "ann_return", "ann_vol", "sharpe", "max_drawdown", "avg_turnover", "avg_cost_drag", "active_total_return", "tracking_error", "information_ratio")


#: The score's bins are 1/100 of five times the turnover; each date's fit by the greatest least mean around each bin.
CALIBRATED_SQL = f"""{FWD}, p AS (SELECT symbol, trade_date, turnover * 5 AS score, CASE WHEN fwd IS NOT NULL THEN CAST(fwd > 0 AS INT) END AS y, CAST(round(turnover * 500 + 1e-9) AS BIGINT) AS k FROM f),
c AS (SELECT trade_date, k, count(y) AS n, sum(y) AS s FROM p GROUP BY 1, 2), cal AS (SELECT DISTINCT trade_date FROM p), bins AS (SELECT DISTINCT k FROM p),
cum AS (SELECT trade_date, k, coalesce(sum(n) OVER w, 0) AS n, coalesce(sum(s) OVER w, 0) AS s FROM cal CROSS JOIN bins LEFT JOIN c USING (trade_date, k) WINDOW w AS (PARTITION BY k ORDER BY trade_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT trade_date, k, row_number() OVER w AS i, sum(n) OVER w AS cn, sum(s) OVER w AS cs, n, s, sum(n) OVER (PARTITION BY trade_date) AS all_n, sum(s) OVER (PARTITION BY trade_date) AS all_s FROM cum WHERE n > 0 WINDOW w AS (PARTITION BY trade_date ORDER BY k)),
u AS (SELECT * FROM t WHERE all_n >= 200 AND all_s > 0 AND all_s < all_n),
m AS (SELECT a.trade_date, a.i AS low, b.i, b.k, min((j.cs - a.cs + a.s) / (j.cn - a.cn + a.n)) AS least FROM u a JOIN u b ON a.trade_date = b.trade_date AND a.i <= b.i JOIN u j ON j.trade_date = b.trade_date AND j.i >= b.i GROUP BY ALL),
fit AS (SELECT trade_date, k, max(least) AS v FROM m GROUP BY 1, 2),
q AS (SELECT trade_date, k, (SELECT max(f.k) FROM fit f WHERE f.trade_date = x.trade_date AND f.k <= x.k) AS k0, (SELECT min(f.k) FROM fit f WHERE f.trade_date = x.trade_date AND f.k >= x.k) AS k1 FROM (SELECT DISTINCT trade_date, k FROM p) x),
v AS (SELECT q.trade_date, q.k, CASE WHEN k0 IS NULL THEN b.v WHEN k1 IS NULL OR k0 = k1 THEN a.v ELSE a.v + (b.v - a.v) * (q.k - k0) / (k1 - k0) END AS calibrated FROM q LEFT JOIN fit a ON a.trade_date = q.trade_date AND a.k = k0 LEFT JOIN fit b ON b.trade_date = q.trade_date AND b.k = k1),
r AS (SELECT p.*, v.calibrated FROM p JOIN v USING (trade_date, k))"""


def scored_outcomes(spark, d):
    df = forward(spark, d)
    return df.select("symbol", "trade_date", (F.col("turnover") * 5).alias("score"), F.when(F.col("fwd").isNotNull(), (F.col("fwd") > 0).cast("int")).alias("y"))


@query(f"WITH {CALIBRATED_SQL} SELECT symbol, trade_date, {r6('calibrated')} FROM r")
def expanding_isotonic(spark, d):
    return rounded(calibration.expanding(scored_outcomes(spark, d), "score", "y", "isotonic", digits=2), "symbol", "trade_date", "calibrated")


@query(f"""WITH {CALIBRATED_SQL}, e AS (SELECT *, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS a, count(*) OVER () AS n FROM r WHERE calibrated IS NOT NULL AND y IS NOT NULL)
SELECT count(*) AS observations, count(DISTINCT trade_date) AS calibration_windows, {r6('avg((a / n - y) * (a / n - y))', 'brier_before')}, {r6('avg((calibrated - y) * (calibrated - y))', 'brier_after')} FROM e""")
def calibration_summary(spark, d):
    found = calibration.expanding(scored_outcomes(spark, d), "score", "y", "isotonic", digits=2)
    return rounded(calibration.brier(found, "score", "y", digits=2), "observations", "calibration_windows", "brier_before", "brier_after")


@query(None)
def expanding_platt(spark, d):
    return rounded(calibration.expanding(scored_outcomes(spark, d), "score", "y", "platt", digits=2), "symbol", "trade_date", "calibrated")
