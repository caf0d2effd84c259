"""Queries of joins in time, intraday measures and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspark.functions import recipes as R
from loomspark.operators import intraday, joins, labels
from loomspark.operators import panel as pn
from loomspark.plans.registry import PANEL_SQL, corr_sql, panel, pct_sql, query, r6, rounded, table

D = pn.PANEL


def reports(spark, d):
    """A history of each entity: orders by the customer's number, as reports that become known later."""
    o = table(spark, d, "orders")
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    entity, day = F.pmod(F.col("o_custkey"), F.lit(40)).cast("long"), F.to_date("o_orderdate")
    return o.groupBy(entity.alias("symbol"), F.trunc(day, "quarter").alias("period")).agg((F.sum(cents) / 100.0).alias("value"), F.max(F.date_add(day, 20)).alias("available"), F.count(F.lit(1)).alias("n"))


REPORTS_SQL = """reports AS (SELECT CAST(o_custkey % 40 AS BIGINT) AS symbol, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS period, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / 100.0 AS value,
  max(CAST(o_orderdate AS DATE) + 20) AS available, count(*) AS n FROM orders GROUP BY 1, 2)"""


@query(f"""WITH {PANEL_SQL}, {REPORTS_SQL} SELECT p.symbol, p.trade_date, r.period, r.available AS available_matched, {r6('CASE WHEN r.n % 3 <> 0 THEN r.value END', 'value')} FROM panel p
ASOF LEFT JOIN (SELECT * FROM reports QUALIFY row_number() OVER (PARTITION BY symbol, available ORDER BY period DESC) = 1) r ON p.symbol = r.symbol AND p.trade_date >= r.available""")
def as_of_reports(spark, d):
    right = reports(spark, d).withColumn("value", F.when(F.col("n") % 3 != 0, F.col("value")))
    df = joins.as_of(panel(spark, d).select("symbol", "trade_date"), right, "trade_date", "available", ["symbol"], ["period", "value"], tie=["period"])
    return rounded(df, "symbol", "trade_date", "period", "available_matched", "value")


CONTEXT_SQL = """context AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS period_end, CAST(date_trunc('month', o_orderdate) AS DATE) + 41 AS visible, CAST(count(*) AS DOUBLE) AS value FROM orders GROUP BY 1, 2)"""


def context(spark, d):
    month = F.to_date(F.date_trunc("month", "o_orderdate"))
    c = table(spark, d, "orders").groupBy(month.alias("period_end")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    return c.withColumn("visible", F.date_add("period_end", 41)).withColumn("feature", F.lit("orders"))


@query(f"""WITH {PANEL_SQL}, {CONTEXT_SQL} SELECT p.symbol, p.trade_date, {r6('CASE WHEN p.trade_date - c.period_end <= 60 THEN c.value END', 'orders')}, CAST(p.trade_date - c.period_end AS BIGINT) AS orders__age_days
FROM panel p ASOF LEFT JOIN context c ON p.trade_date >= c.visible""")
def context_as_of(spark, d):
    df = joins.context_as_of(panel(spark, d), context(spark, d), ["orders"], {"orders": 60})
    return rounded(df, "symbol", "trade_date", "orders", "orders__age_days")


@query(f"""WITH {PANEL_SQL}, {REPORTS_SQL}, m AS (SELECT symbol, period AS in_date, CASE WHEN n % 4 <> 0 THEN period + 200 END AS out_date, 'g' || CAST(n % 7 AS VARCHAR) AS grp FROM reports)
SELECT p.symbol, p.trade_date, max_by(grp, in_date) AS grp FROM panel p LEFT JOIN m ON m.symbol = p.symbol AND p.trade_date BETWEEN in_date AND coalesce(out_date, DATE '9999-12-31') GROUP BY 1, 2""")
def interval_membership(spark, d):
    m = reports(spark, d).select("symbol", F.col("period").alias("in_date"), F.when(F.col("n") % 4 != 0, F.date_add("period", 200)).alias("out_date"), F.concat(F.lit("g"), F.col("n") % 7).alias("grp"))
    return joins.interval_member(panel(spark, d).select("symbol", "trade_date"), m, "in_date", "out_date", "grp")


@query(f"""WITH {PANEL_SQL}, {REPORTS_SQL}, u AS (SELECT DISTINCT period AS rebalance, symbol FROM reports WHERE n > 8), d AS (SELECT DISTINCT rebalance FROM u)
SELECT p.symbol, p.trade_date, d.rebalance FROM panel p ASOF JOIN d ON p.trade_date >= d.rebalance WHERE EXISTS (SELECT 1 FROM u WHERE u.rebalance = d.rebalance AND u.symbol = p.symbol)""")
def universe_as_of(spark, d):
    u = reports(spark, d).filter("n > 8").select(F.col("period").alias("rebalance"), "symbol")
    return joins.universe_as_of(panel(spark, d).select("symbol", "trade_date"), u, "rebalance")


CAL = "cal AS (SELECT trade_date, row_number() OVER (ORDER BY trade_date) AS pos FROM (SELECT DISTINCT trade_date FROM panel))"


@query(f"""WITH {PANEL_SQL}, {CAL} SELECT p.symbol, p.trade_date, n.trade_date AS next_date, {r6('q.close', 'next_close')}, {r6('b.volume', 'old_volume')}, b.symbol IS NOT NULL AS features_available
FROM panel p JOIN cal c ON c.trade_date = p.trade_date LEFT JOIN cal n ON n.pos = c.pos + 3 LEFT JOIN panel q ON q.symbol = p.symbol AND q.trade_date = n.trade_date
LEFT JOIN cal o ON o.pos = c.pos - 2 LEFT JOIN panel b ON b.symbol = p.symbol AND b.trade_date = o.trade_date""")
def calendar_lookup(spark, d):
    df = joins.lookup(joins.future_date(panel(spark, d), 3, "next_date"), "close", "next_date", "next_close")
    old = panel(spark, d).select("symbol", "trade_date", F.col("volume").alias("old_volume"))
    return rounded(joins.lagged_features(df, old, ["old_volume"], 2), "symbol", "trade_date", "next_date", "next_close", "old_volume", "features_available")


@query(f"""WITH {REPORTS_SQL} SELECT a.symbol, a.period, {r6('CASE WHEN b.available > a.available THEN (b.value - a.value) / abs(nullif(a.value, 0)) END', 'target')}, CASE WHEN b.available > a.available THEN b.available END AS label_end
FROM reports a LEFT JOIN reports b ON a.symbol = b.symbol AND b.period = a.period + INTERVAL 12 MONTH""")
def period_target(spark, d):
    return rounded(joins.period_target(reports(spark, d), "symbol", "period", "available", "value", 12, "pct_change"), "symbol", "period", "target", "label_end")


@query(f"""WITH {REPORTS_SQL}, {CONTEXT_SQL}, s AS (SELECT period_end AS d, value / lag(value) OVER (ORDER BY period_end) - 1 AS r FROM context)
SELECT symbol, period, {r6('(SELECT exp(sum(ln(1 + r))) - 1 FROM s WHERE d > period AND d <= available)', 'benchmark')} FROM reports""")
def benchmark_compounded(spark, d):
    s = context(spark, d).withColumn("r", R.pct_change("value", R.by(F.lit(0)).orderBy("period_end")))
    df = joins.compounded_between(reports(spark, d).select("symbol", "period", "available"), s, "period", "available", "period_end", "r", "benchmark")
    return rounded(df, "symbol", "period", "benchmark")


@query(f"""WITH {REPORTS_SQL} SELECT symbol, period FROM reports WHERE NOT (period <= DATE '1997-06-30' AND available >= DATE '1997-01-01') AND NOT (period > DATE '1997-06-30' AND period <= DATE '1997-06-30' + 90)""")
def purge_and_embargo(spark, d):
    return joins.purge(reports(spark, d), "1997-01-01", "1997-06-30", 90, "period", "available").select("symbol", "period")


@query("""WITH v AS (SELECT CAST(o_custkey % 40 AS BIGINT) AS symbol, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS period, CAST(o_orderdate AS DATE) AS available, count(*) AS n FROM orders GROUP BY 1, 2, 3)
SELECT * FROM v WHERE available <= DATE '1998-03-31' QUALIFY row_number() OVER (PARTITION BY symbol, period ORDER BY available DESC) = 1""")
def latest_vintages(spark, d):
    day = F.to_date("o_orderdate")
    v = table(spark, d, "orders").groupBy(F.pmod("o_custkey", F.lit(40)).cast("long").alias("symbol"), F.trunc(day, "quarter").alias("period"), day.alias("available")).agg(F.count(F.lit(1)).alias("n"))
    return joins.latest_vintages(v, "1998-03-31", "symbol", "period", "available")


@query(f"""WITH {REPORTS_SQL}, g AS (SELECT symbol, period AS trade_date, value FROM reports), s AS (SELECT a.symbol, a.trade_date, count(b.value) AS n, median(b.value) AS m, stddev_pop(b.value) AS s, avg(CAST(b.value > 500000 AS INT)) AS p FROM g a JOIN g b ON a.symbol = b.symbol AND b.trade_date <= a.trade_date AND b.trade_date >= a.trade_date - INTERVAL 36 MONTH GROUP BY 1, 2)
SELECT symbol, trade_date, {r6('CASE WHEN n >= 3 THEN m END', 'median_36', 2)}, {r6('CASE WHEN n >= 3 THEN s END', 'std_36', 2)} FROM s""")
def trailing_calendar_stats(spark, d):
    g = reports(spark, d).select("symbol", F.col("period").alias("trade_date"), "value")
    df = joins.trailing_calendar_stat(g, "value", 36, "median", 3, "median_36")
    return rounded(joins.trailing_calendar_stat(df, "value", 36, "std0", 3, "std_36"), "symbol", "trade_date", "median_36", "std_36", digits=2)


@query(f"""WITH {REPORTS_SQL}, g AS (SELECT symbol, period AS trade_date, CASE WHEN n % 5 <> 0 THEN value END AS value FROM reports), a AS (SELECT *, CAST(trade_date - INTERVAL 26 MONTH AS DATE) AS ask FROM g)
SELECT a.symbol, a.trade_date, {r6('CASE WHEN a.value > 0 AND b.value > 0 THEN power(a.value / b.value, 365.25 / (a.trade_date - b.trade_date)) - 1 END', 'growth')} FROM a ASOF LEFT JOIN (SELECT * FROM g WHERE value IS NOT NULL) b ON a.symbol = b.symbol AND a.ask >= b.trade_date""")
def calendar_growth(spark, d):
    return _calendar_growth(reports(spark, d).withColumn("value", F.expr("CASE WHEN n % 5 <> 0 THEN value END")))


def _calendar_growth(found):
    g = found.select("symbol", F.col("period").alias("trade_date"), "value")
    return rounded(joins.calendar_growth(g, "value", 26, "growth"), "symbol", "trade_date", "growth")


def bars(spark, d):
    """Events by user and day: a bar for each, whose number is its hour."""
    e = table(spark, d, "events")
    price = F.floor(F.col("value") * 100).cast("long") / 100.0 + 1
    stamp = "ts"
    return e.select(F.col("user_id").cast("long").alias("symbol"), F.to_date(stamp).alias("trade_date"), F.hour(stamp).cast("long").alias("bar_index"), F.date_format(stamp, "HH:mm:ss").alias("bar_time"), price.alias("close"), (F.pmod(F.col("event_id"), F.lit(50)) + 1).cast("double").alias("volume"), F.col("event_id").cast("long").alias("event_id"))


BARS_SQL = """bars AS (SELECT CAST(user_id AS BIGINT) AS symbol, CAST(ts AS DATE) AS trade_date, CAST(hour(ts) AS BIGINT) AS bar_index, strftime(ts, '%H:%M:%S') AS bar_time,
  floor(value * 100) / 100.0 + 1 AS close, CAST(event_id % 50 + 1 AS DOUBLE) AS volume, CAST(event_id AS BIGINT) AS event_id FROM events)"""


def day_bars(spark, d):
    """All events of a day as bars of one entity a type, one a second at most."""
    e = bars(spark, d).withColumn("symbol", F.pmod("symbol", F.lit(5)))
    one = pn.keep_one(e, ["symbol", "trade_date", "bar_time"], ["event_id"])
    return one.withColumn("open", F.col("close") + 0.5).withColumn("high", F.col("close") + 1).withColumn("low", F.col("close") - 0.5)


DAY_BARS_SQL = f"""{BARS_SQL}, day AS (SELECT symbol % 5 AS symbol, trade_date, bar_index, bar_time, close, volume, event_id, close + 0.5 AS open, close + 1 AS high, close - 0.5 AS low FROM bars
  QUALIFY row_number() OVER (PARTITION BY symbol % 5, trade_date, bar_time ORDER BY event_id) = 1)"""


@query(f"""WITH {DAY_BARS_SQL}, r AS (SELECT *, CASE WHEN bar_time >= '09:35:00' THEN close / lag(close) OVER (PARTITION BY symbol, trade_date ORDER BY bar_time) - 1 END AS ret FROM day)
SELECT symbol, trade_date, {r6('sqrt(sum(ret * ret))', 'realized_vol')}, {r6('sqrt(sum(CASE WHEN ret IS NOT NULL THEN power(least(ret, 0), 2) END))', 'downside_vol')},
  {r6('(max(high) - min(low)) / nullif(min_by(open, bar_time), 0)', 'range_over_open')}, {r6('(max_by(close, bar_time) - min(low)) / nullif(max(high) - min(low), 0)', 'close_location')},
  {r6("max_by(close, bar_time) / nullif(min_by(close, bar_time) FILTER (bar_time >= '14:30:00'), 0) - 1", 'late_return')}, {r6("sum(volume) FILTER (bar_time <= '10:00:00') / nullif(sum(volume), 0)", 'open_volume_share')},
  {r6("sum(volume) FILTER (bar_time >= '14:30:00') / nullif(sum(volume), 0)", 'late_volume_share')}, {r6('sum(volume * volume) / nullif(power(sum(volume), 2), 0)', 'volume_hhi')}, {r6('avg(CAST(volume > 0 AS INT))', 'active_ratio')},
  {r6(corr_sql('volume', 'ret'), 'volume_return_corr')}, {r6('stddev_samp(volume) / nullif(avg(volume), 0)', 'volume_cv')}, count(*) AS n_bars FROM r GROUP BY symbol, trade_date""")
def minute_day_measures(spark, d):
    names = ["realized_vol", "downside_vol", "range_over_open", "close_location", "late_return", "open_volume_share", "late_volume_share", "volume_hhi", "active_ratio", "volume_return_corr", "volume_cv", "n_bars"]
    return rounded(intraday.day_measures(day_bars(spark, d)), "symbol", "trade_date", *names)


@query(f"""WITH {BARS_SQL}, b AS (SELECT *, close + 0.25 AS open FROM bars),
dg AS (SELECT symbol, trade_date, count(*) AS n_rows, count(DISTINCT bar_index) AS n_bars, count(bar_index) - count(DISTINCT bar_index) AS n_duplicates FROM b GROUP BY ALL),
one AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY symbol, trade_date, bar_index ORDER BY open, close, volume) = 1),
x AS (SELECT *, lag(bar_index) OVER w = bar_index - 1 AS near, lag(close) OVER w AS pc, lag(volume) OVER w AS pv, row_number() OVER w AS k FROM one WINDOW w AS (PARTITION BY symbol, trade_date ORDER BY bar_index)),
y AS (SELECT *, CASE WHEN near THEN ln(close / pc) WHEN k = 1 THEN ln(close / open) END AS r, abs(pv - volume) AS jump FROM x),
z AS (SELECT *, CASE WHEN near THEN abs(r) * abs(lag(r) OVER w) END AS pair, coalesce(volume > avg(volume) OVER g + stddev_pop(volume) OVER g, false) AS a1 FROM y WINDOW w AS (PARTITION BY symbol, trade_date ORDER BY bar_index), g AS (PARTITION BY symbol, trade_date)),
e AS (SELECT *, a1 AND NOT lag(a1, 1, false) OVER (PARTITION BY symbol, trade_date ORDER BY bar_index) AS rise FROM z),
v AS (SELECT symbol, trade_date, stddev_pop(volume) / avg(volume) AS cv, avg(jump) / avg(volume) AS vd, sum(r * r) AS rv, sum(CASE WHEN r < 0 THEN r * r WHEN r IS NOT NULL THEN 0 END) AS rd, CASE WHEN count(pair) > 0 THEN pi() / 2 * sum(pair) * count(r) / count(pair) END AS bp, sum(CAST(rise AS INT)) AS p1 FROM e GROUP BY ALL)
SELECT symbol, trade_date, n_rows, n_bars, n_duplicates, {r6('CASE WHEN n_duplicates = 0 THEN cv END', 'volume_cv')}, {r6('CASE WHEN n_duplicates = 0 THEN vd END', 'volume_diff')}, {r6('CASE WHEN n_duplicates = 0 THEN rv END', 'rv')},
  {r6('CASE WHEN n_duplicates = 0 THEN bp END', 'bipower')}, CASE WHEN n_duplicates = 0 THEN CAST(p1 AS BIGINT) END AS peaks_1, {r6('CASE WHEN n_duplicates = 0 THEN rd / nullif(rv, 0) END', 'downside_share')}, {r6('CASE WHEN n_duplicates = 0 AND bp IS NOT NULL THEN greatest(rv - bp, 0) / nullif(rv, 0) WHEN n_duplicates = 0 AND rv IS NOT NULL THEN 0 / nullif(rv, 0) END', 'jump_share')}, {r6('n_bars / 24', 'coverage')} FROM dg JOIN v USING (symbol, trade_date)""")
def minute_peak_measures(spark, d):
    return _minute_peak_measures(bars(spark, d))


def _minute_peak_measures(b):
    b = b.withColumn("open", F.col("close") + 0.25)
    return rounded(intraday.peak_measures(b, 24), "symbol", "trade_date", "n_rows", "n_bars", "n_duplicates", "volume_cv", "volume_diff", "rv", "bipower", "peaks_1", "downside_share", "jump_share", "coverage")


@query(f"""WITH {BARS_SQL}, f AS (SELECT * FROM bars QUALIFY row_number() OVER (PARTITION BY symbol, trade_date ORDER BY bar_index, close, volume) <= 2),
v AS (SELECT symbol, trade_date, sum(close * volume) / nullif(sum(volume), 0) AS vwap FROM f GROUP BY ALL),
s AS (SELECT symbol, trade_date, coalesce(sum(volume) FILTER (least(floor(bar_index * 4 / 24), 3) = 0) / nullif(sum(volume), 0), 0) AS share_0, coalesce(sum(volume) FILTER (least(floor(bar_index * 4 / 24), 3) = 3) / nullif(sum(volume), 0), 0) AS share_3 FROM bars GROUP BY ALL)
SELECT symbol, trade_date, {r6('vwap')}, {r6('share_0')}, {r6('share_3')} FROM v JOIN s USING (symbol, trade_date)""")
def minute_vwap_and_shares(spark, d):
    b = bars(spark, d)
    return rounded(intraday.morning_vwap(b, 2).join(intraday.volume_shares(b, 4, 24), ["symbol", "trade_date"]), "symbol", "trade_date", "vwap", "share_0", "share_3")


@query(f"""WITH {DAY_BARS_SQL}, m AS (SELECT *, round(abs(close / lag(close) OVER (PARTITION BY symbol, trade_date ORDER BY bar_index, close, volume) - 1) / power(volume, 0.1), 9) AS s FROM day),
c AS (SELECT *, sum(volume) OVER (PARTITION BY symbol, trade_date ORDER BY s DESC, bar_index, close, volume ROWS UNBOUNDED PRECEDING) AS c, sum(volume) OVER (PARTITION BY symbol, trade_date) AS t FROM m WHERE s IS NOT NULL)
SELECT symbol, trade_date, {r6('sum(close * volume) FILTER (c <= 0.2 * t) / nullif(sum(volume) FILTER (c <= 0.2 * t), 0) / (sum(close * volume) / nullif(sum(volume), 0))', 'smart_money_q')} FROM c GROUP BY symbol, trade_date""")
def minute_smart_money(spark, d):
    return rounded(intraday.smart_money(day_bars(spark, d)), "symbol", "trade_date", "smart_money_q")


@query(f"""WITH {PANEL_SQL}, f AS (SELECT *, lead(close, 5) OVER h / close - 1 AS forward_return, lead(trade_date, 5) OVER h AS label_end FROM panel WINDOW h AS (PARTITION BY symbol ORDER BY trade_date))
SELECT symbol, trade_date, {r6('forward_return')}, label_end, {r6(pct_sql('forward_return'), 'forward_rank')} FROM f""")
def forward_rank_label(spark, d):
    return rounded(labels.forward_rank(panel(spark, d), "close", 5), "symbol", "trade_date", "forward_return", "label_end", "forward_rank")


@query(f"""WITH {PANEL_SQL}, f AS (SELECT *, lead(close, 1) OVER h / close - 1 AS a, lead(close, 3) OVER h / close - 1 AS b, lead(trade_date, 3) OVER h AS label_end FROM panel WINDOW h AS (PARTITION BY symbol ORDER BY trade_date)), r AS (SELECT *, {pct_sql('a')} AS ra, {pct_sql('b')} AS rb FROM f)
SELECT symbol, trade_date, {r6('0.25 * ra + 0.75 * rb', 'blended_rank')}, label_end FROM r""")
def blended_rank_label(spark, d):
    return rounded(labels.blended_forward_rank(panel(spark, d), "close", {1: 1.0, 3: 3.0}), "symbol", "trade_date", "blended_rank", "label_end")


@query(f"""WITH {PANEL_SQL}, {CAL}, x AS (SELECT *, CASE WHEN close < high - greatest(abs(high) * 1e-8, 1e-8) AND n_lines % 5 <> 3 AND close > 0 THEN close END AS i, CASE WHEN close > low + greatest(abs(low) * 1e-8, 1e-8) AND n_lines % 5 <> 3 AND close > 0 THEN close END AS o FROM (SELECT * REPLACE (CASE WHEN n_lines = 1 THEN high + 1 ELSE high END AS high, CASE WHEN n_lines = 1 THEN low - 1 ELSE low END AS low) FROM panel)),
y AS (SELECT p.symbol, p.trade_date, a.i AS entry, CASE WHEN p.volume > 10 THEN b.o / a.i - 1 END AS r1, CASE WHEN p.volume > 10 THEN c.o / a.i - 1 END AS r2 FROM panel p JOIN cal k ON k.trade_date = p.trade_date
  LEFT JOIN cal k1 ON k1.pos = k.pos + 1 LEFT JOIN x a ON a.symbol = p.symbol AND a.trade_date = k1.trade_date LEFT JOIN cal k2 ON k2.pos = k.pos + 2 LEFT JOIN x b ON b.symbol = p.symbol AND b.trade_date = k2.trade_date
  LEFT JOIN cal k3 ON k3.pos = k.pos + 3 LEFT JOIN x c ON c.symbol = p.symbol AND c.trade_date = k3.trade_date), z AS (SELECT *, {pct_sql('r1')} AS q1, {pct_sql('r2')} AS q2 FROM y)
SELECT symbol, trade_date, {r6('r1', 'open_return_1')}, {r6('r2', 'open_return_2')}, {r6('0.5 * q1 + 0.5 * q2', 'open_label')} FROM z""")
def next_open_label(spark, d):
    df = panel(spark, d).withColumn("high", F.when(F.col("n_lines") == 1, F.col("high") + 1).otherwise(F.col("high"))).withColumn("low", F.when(F.col("n_lines") == 1, F.col("low") - 1).otherwise(F.col("low")))
    df = df.withColumn("suspended", F.when(F.col("n_lines") % 5 == 3, "true").otherwise("no")).withColumn("eligible", F.col("volume") > 10)
    return rounded(labels.next_open(df, "close", {1: 1.0, 2: 1.0}, "high", "low", "suspended", "eligible"), "symbol", "trade_date", "open_return_1", "open_return_2", "open_label")


@query(f"""WITH {PANEL_SQL}, n AS (SELECT symbol, trade_date, close, row_number() OVER (PARTITION BY symbol ORDER BY trade_date) AS n, volume FROM panel),
e AS (SELECT symbol * 100000 + n AS event_id, symbol, trade_date, close AS entry, n, CASE WHEN volume % 2 = 0 THEN 1 ELSE -1 END AS side FROM n),
m AS (SELECT e.*, q.n - e.n AS k, q.trade_date AS d, (q.close / entry - 1) * side AS r FROM e JOIN n q ON q.symbol = e.symbol AND q.n > e.n AND q.n <= e.n + 5),
t AS (SELECT *, CASE WHEN r >= 0.5 THEN 'profit_taking' WHEN r <= -0.4 THEN 'stop_loss' WHEN k = 5 THEN 'vertical' END AS barrier FROM m)
SELECT event_id, symbol, trade_date, barrier, d AS touched, {r6('r', 'side_return')}, CAST(CASE barrier WHEN 'profit_taking' THEN 1 WHEN 'stop_loss' THEN -1 ELSE sign(r) END AS BIGINT) AS label, CAST(r > 0 AS BIGINT) AS meta_label FROM t WHERE barrier IS NOT NULL QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY k) = 1""")
def triple_barrier(spark, d):
    n = panel(spark, d).withColumn("n", F.row_number().over(D.history()))
    return _triple_barrier(n, n)


def _triple_barrier(n, starts):
    e = starts.select((F.col("symbol") * 100000 + F.col("n")).alias("event_id"), "symbol", "trade_date", F.lit(0.1).alias("target"), F.when(F.col("volume") % 2 == 0, 1).otherwise(-1).alias("side"))
    found = labels.meta_label(labels.triple_barrier(n, e, 5, 5.0, 4.0), "side_return")
    return rounded(found, "event_id", "symbol", "trade_date", "barrier", "touched", "side_return", "label", "meta_label")


@query(f"""WITH {REPORTS_SQL}, c AS (SELECT symbol, period, available, CASE WHEN n % 9 <> 0 THEN sum(value) OVER (PARTITION BY symbol, year(period) ORDER BY period) END AS ytd FROM reports),
q AS (SELECT *, CASE WHEN quarter(period) = 1 THEN ytd WHEN quarter(lag(period) OVER w) = quarter(period) - 1 THEN ytd - lag(ytd) OVER w END AS ytd_q FROM c WINDOW w AS (PARTITION BY symbol, year(period) ORDER BY period))
SELECT symbol, period, {r6('ytd', 'ytd', 2)}, {r6('ytd_q', 'ytd_q', 2)} FROM q""")
def quarterly_flows(spark, d):
    ytd = F.sum("value").over(R.by("symbol", F.year("period")).orderBy("period"))
    return _quarterly_flows(reports(spark, d).withColumn("ytd", F.when(F.col("n") % 9 != 0, ytd)))


def _quarterly_flows(r):
    return rounded(labels.quarterly(r, ["ytd"], "symbol", "period", "available"), "symbol", "period", "ytd", "ytd_q", digits=2)


@query(f"""WITH {REPORTS_SQL}, v AS (SELECT symbol, period, CASE WHEN n % 11 <> 0 THEN CAST(n AS DOUBLE) - 8 END AS x, year(period) * 4 + quarter(period) AS q FROM reports), s AS (SELECT *, count(x) OVER w AS n_known, count(CASE WHEN x > 0 THEN 1 END) OVER w AS n_positive, max(q) OVER w - min(q) OVER w = 11 AND count(*) OVER w = 12 AS gapless, median(x) OVER w AS m, stddev_pop(x) OVER w AS sd FROM v WINDOW w AS (PARTITION BY symbol ORDER BY period ROWS BETWEEN 11 PRECEDING AND CURRENT ROW))
SELECT symbol, period, n_known, gapless, n_positive, {r6('CASE WHEN n_known >= 8 THEN m END', 'median')}, {r6('CASE WHEN n_known >= 8 THEN sd END', 'deviation')}, CASE WHEN n_known >= 8 AND gapless THEN n_positive >= 10 END AS strict FROM s""")
def rolling_stability(spark, d):
    v = reports(spark, d).withColumn("x", F.when(F.col("n") % 11 != 0, F.col("n").cast("double") - 8))
    return rounded(labels.stability(v, "x", "symbol", "period"), "symbol", "period", "n_known", "gapless", "n_positive", "median", "deviation", "strict")


@query("""WITH p AS (SELECT doc_id, (n_chars % 997 + 1) / 999.0 AS p FROM documents), z AS (SELECT *, (p - 0.5) / sqrt(p * (1 - p)) AS z FROM p), t AS (SELECT *, 1 / (1 + abs(z) * 0.2316419) AS t FROM z)
SELECT doc_id, round(CAST(round_even(sign(z) * (1 - 2 * (exp(-z * z / 2) / sqrt(2 * pi()) * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429)))))) / 0.05, 0) * 0.05 AS DOUBLE) + 1e-07, 4) + 0.0 AS bet FROM t""")
def bet_sizes(spark, d):
    p = table(spark, d, "documents").select("doc_id", ((F.col("n_chars") % 997 + 1) / F.lit(999.0)).alias("p"))
    return rounded(p.withColumn("bet", labels.bet_size("p", step=0.05)), "doc_id", "bet")
