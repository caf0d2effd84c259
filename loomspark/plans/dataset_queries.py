"""Queries of datasets, lagged joins, scores, labels, folds and inference over dates."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspark.operators import cross_section as cs
from loomspark.operators import inference as inf
from loomspark.operators import joins, labels, splits
from loomspark.operators import panel as pn
from loomspark.plans.diagnostic_queries import FWD, SERIES_SQL, forward, series
from loomspark.plans.registry import PANEL_SQL, panel, query, r6, rounded, table


@query(f"WITH {PANEL_SQL} SELECT trade_date, symbol, {r6('close')}, {r6('pb')}, {r6('volume')} FROM panel")
def role_columns(spark, d):
    schema = pn.Schema(price="close", features=("pb", "volume", "close"))
    return rounded(pn.dataset(panel(spark, d), schema), *schema.columns()[:2], "close", "pb", "volume")


@query("SELECT l_suppkey AS symbol, CAST(l_shipdate AS DATE) AS trade_date, l_orderkey, l_linenumber FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_suppkey, CAST(l_shipdate AS DATE) ORDER BY l_orderkey DESC, l_linenumber) = 1")
def one_line_a_day(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("symbol"), F.to_date("l_shipdate").alias("trade_date"), "l_orderkey", "l_linenumber")
    return pn.keep_one(rows, ["symbol", "trade_date"], [F.col("l_orderkey").desc(), "l_linenumber"])


@query(f"""WITH {PANEL_SQL}, days AS (SELECT trade_date, row_number() OVER (ORDER BY trade_date) AS k FROM (SELECT DISTINCT trade_date FROM panel)),
p AS (SELECT panel.*, k FROM panel JOIN days USING (trade_date))
SELECT a.symbol, a.trade_date, round(a.close + 1e-7, 4) + 0.0 AS close, round(b.pb + 1e-7, 4) + 0.0 AS pb, b.symbol IS NOT NULL AS features_available FROM p a LEFT JOIN p b ON a.symbol = b.symbol AND b.k = a.k - 2""")
def features_two_dates_ago(spark, d):
    df = panel(spark, d)
    found = joins.lagged_features(df.select("symbol", "trade_date", "close"), df, ["pb"], 2)
    return rounded(found, "symbol", "trade_date", "close", "pb", "features_available")


@query(f"""WITH {PANEL_SQL}, z AS (SELECT symbol, trade_date, CASE WHEN pb IS NOT NULL THEN coalesce((pb - avg(pb) OVER w) / nullif(stddev_pop(pb) OVER w, 0), 0) END AS a,
  coalesce((close - avg(close) OVER w) / nullif(stddev_pop(close) OVER w, 0), 0) AS b FROM panel WINDOW w AS (PARTITION BY trade_date))
SELECT symbol, trade_date, {r6('CASE WHEN a IS NULL THEN b ELSE (a + b) / 2 END', 'score')} FROM z""")
def mean_of_scores(spark, d):
    return rounded(cs.mean_zscore(panel(spark, d), ["pb", "close"], "score"), "symbol", "trade_date", "score")


@query(f"WITH {FWD} SELECT symbol, trade_date, CAST(CASE WHEN fwd > 0 THEN 1 WHEN fwd IS NOT NULL THEN 0 END AS BIGINT) AS meta_label FROM f")
def meta_labels(spark, d):
    return rounded(labels.meta_label(forward(spark, d), "fwd"), "symbol", "trade_date", "meta_label")


@query(f"""WITH {PANEL_SQL}, days AS (SELECT trade_date, row_number() OVER (ORDER BY trade_date) AS k, count(*) OVER () AS n FROM (SELECT DISTINCT trade_date FROM panel)),
f AS (SELECT fold, n - (6 - fold) * 20 - 20 AS a FROM range(1, 7) t(fold), (SELECT max(n) AS n FROM days)),
g AS (SELECT fold, a, greatest(0, a - 5 - 100) AS low, greatest(0, a - 5) AS high FROM f WHERE a > 0 AND a - 5 > 0)
SELECT fold, min(CASE WHEN k > low AND k <= high THEN trade_date END) AS train_from, max(CASE WHEN k > low AND k <= high THEN trade_date END) AS train_to, count(*) FILTER (k > low AND k <= high) AS n_train,
  min(CASE WHEN k > a THEN trade_date END) AS test_from, max(CASE WHEN k > a AND k <= a + 20 THEN trade_date END) AS test_to, count(*) FILTER (k > a AND k <= a + 20) AS n_test FROM g, days GROUP BY fold""")
def walk_forward_folds(spark, d):
    """Windows of 20 dates, numbered to the last, each after a gap of 5 and 100 dates of training."""
    dates = [r.trade_date for r in panel(spark, d).select("trade_date").distinct().collect()]  # a value a date
    folds = splits.walk_forward(dates, 20, 6, gap=5, train_size=100)
    first = 7 - len(folds)
    rows = [(first + k, f.train[0], f.train[-1], len(f.train), f.test[0], f.test[-1], len(f.test)) for k, f in enumerate(folds)]
    return spark.createDataFrame(rows, "fold long, train_from date, train_to date, n_train long, test_from date, test_to date, n_test long")


@query(f"""WITH {PANEL_SQL}, {SERIES_SQL}, e AS (SELECT x - avg(x) OVER () AS e, x, row_number() OVER (ORDER BY trade_date) AS k FROM s),
l AS (SELECT e, x, lag(e, 1) OVER (ORDER BY k) AS e1, lag(e, 2) OVER (ORDER BY k) AS e2, lag(e, 3) OVER (ORDER BY k) AS e3 FROM e),
m AS (SELECT count(*) AS n, avg(x) AS mean, sqrt(greatest(0, sum(e * e) + 1.5 * sum(e * e1) + 1.0 * sum(e * e2) + 0.5 * sum(e * e3))) / count(*) AS error FROM l)
SELECT n, {r6('mean')}, {r6('error')}, {r6('mean / error', 't')}, CAST(3 AS BIGINT) AS lag FROM m""")
def mean_inference(spark, d):
    return rounded(inf.newey_west_of(series(spark, d), "x", "trade_date", 3), "n", "mean", "error", "t", "lag")


#: Each column of the corrected reports by its own latest known value, else of the first reports, else the panel's own.
OVERLAY_SQL = f"""{PANEL_SQL}, p AS (SELECT symbol, trade_date, pb, turnover FROM panel),
late AS (SELECT symbol, trade_date + 40 AS since, CASE WHEN n_lines % 2 = 0 THEN pb END AS pb, CASE WHEN n_lines % 3 = 0 THEN turnover END AS turnover FROM panel),
early AS (SELECT symbol, trade_date + 3 AS since, CASE WHEN n_lines % 2 = 1 THEN pb + 1 END AS pb FROM panel)"""


def _seen_sql(source: str, column: str) -> str:
    return f"(SELECT max_by(struct_pack(v := {column}, a := since), since) FROM {source} s WHERE s.symbol = p.symbol AND s.since <= p.trade_date AND s.{column} IS NOT NULL)"


@query(f"""WITH {OVERLAY_SQL}, x AS (SELECT p.*, {_seen_sql('late', 'pb')} AS lp, {_seen_sql('early', 'pb')} AS ep, {_seen_sql('late', 'turnover')} AS lt FROM p)
SELECT symbol, trade_date, {r6('coalesce(lp.v, ep.v, pb)', 'pb')}, CASE WHEN lp.v IS NOT NULL THEN 'late' WHEN ep.v IS NOT NULL THEN 'early' WHEN pb IS NOT NULL THEN 'panel' END AS pb__source, CASE WHEN lp.v IS NOT NULL THEN lp.a WHEN ep.v IS NOT NULL THEN ep.a WHEN pb IS NOT NULL THEN trade_date END AS pb__as_of,
  {r6('coalesce(lt.v, turnover)', 'turnover')}, CASE WHEN lt.v IS NOT NULL THEN 'late' WHEN turnover IS NOT NULL THEN 'panel' END AS turnover__source FROM x""")
def fundamentals_overlay(spark, d):
    df = panel(spark, d)
    late = df.select("symbol", F.date_add("trade_date", 40).alias("at"), F.when(F.col("n_lines") % 2 == 0, F.col("pb")).alias("pb"), F.when(F.col("n_lines") % 3 == 0, F.col("turnover")).alias("turnover"))
    early = df.select("symbol", F.date_add("trade_date", 3).alias("at"), F.when(F.col("n_lines") % 2 == 1, F.col("pb") + 1).alias("pb"))
    out = joins.overlay(df.select("symbol", "trade_date", "pb", "turnover"), [("late", late, "at"), ("early", early, "at")], ["pb", "turnover"], own="panel")
    return rounded(out, "symbol", "trade_date", "pb", "pb__source", "pb__as_of", "turnover", "turnover__source")
