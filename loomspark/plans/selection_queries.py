"""Queries of rankings and selections."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspark.operators import cross_section as cs
from loomspark.operators import diagnostics as dg
from loomspark.operators import selection as sel
from loomspark.plans.diagnostic_queries import FWD, LONG, forward, ranked_sql
from loomspark.plans.registry import PANEL_SQL, corr_sql, panel, pct_sql, query, r6, rounded, table


@query(f"""WITH {PANEL_SQL}, a AS (SELECT *, row_number() OVER (PARTITION BY trade_date ORDER BY close DESC, symbol) AS base_rank, count(*) OVER (PARTITION BY trade_date) AS n FROM panel),
b AS (SELECT *, CASE WHEN n < 5 THEN 'too_few' END AS reason, coalesce(base_rank <= 8 AND close >= 0.6 * max(CASE WHEN base_rank = 5 THEN close END) OVER (PARTITION BY trade_date) AND n >= 5, false) AS in_band FROM a),
c AS (SELECT *, CASE WHEN in_band THEN pb END AS p, CASE WHEN in_band THEN volume END AS v FROM b), d AS (SELECT *, {pct_sql('p')} AS rp, {pct_sql('v')} AS rv FROM c), e AS (SELECT *, CASE WHEN in_band THEN round((coalesce(2 * rp, 0) + coalesce(rv, 0)) / nullif((rp IS NOT NULL)::INT * 2 + (rv IS NOT NULL)::INT, 0), 9) END AS composite FROM d),
f AS (SELECT *, CASE WHEN in_band THEN row_number() OVER (PARTITION BY trade_date, in_band ORDER BY composite DESC NULLS LAST, base_rank) END AS challenger_rank FROM e) SELECT symbol, trade_date, base_rank, reason, in_band, challenger_rank, coalesce(challenger_rank <= 5, false) AS selected FROM f""")
def challenger_ranking(spark, d):
    df = sel.challenger_ranking(panel(spark, d), "close", {"pb": 2.0, "volume": 1.0}, 5, 8, 0.6)
    return rounded(df, "symbol", "trade_date", "base_rank", "reason", "in_band", "challenger_rank", "selected")


@query(f"""WITH {PANEL_SQL} SELECT symbol, trade_date, {r6('coalesce(pb, 0) * 2 + volume * 0.1 - 0.5 * least(greatest(volume - 30, 0), 15) - 3 * least(greatest(turnover - 0.06, 0), 1)', 'score')} FROM panel""")
def penalised_score(spark, d):
    df = panel(spark, d).withColumn("score", sel.penalised_score({"pb": 2.0, "volume": 0.1}, [("volume", 30.0, 0.5, 15.0), ("turnover", 0.06, 3.0, 1.0)]))
    return rounded(df, "symbol", "trade_date", "score")


@query(f"""WITH {PANEL_SQL}, r AS (SELECT symbol, trade_date, row_number() OVER (PARTITION BY trade_date ORDER BY close DESC, symbol) AS rank FROM panel), h AS (SELECT symbol, trade_date FROM r WHERE rank <= 3), c AS (SELECT trade_date, lag(trade_date) OVER (ORDER BY trade_date) AS previous_date FROM (SELECT DISTINCT trade_date FROM h)),
x AS (SELECT h.symbol, c.trade_date, c.previous_date, 'entrant' AS kind FROM h JOIN c USING (trade_date) WHERE previous_date IS NOT NULL AND NOT EXISTS (SELECT 1 FROM h b WHERE b.symbol = h.symbol AND b.trade_date = c.previous_date)
  UNION ALL SELECT h.symbol, c.trade_date, c.previous_date, 'exit' FROM h JOIN c ON h.trade_date = c.previous_date WHERE NOT EXISTS (SELECT 1 FROM h b WHERE b.symbol = h.symbol AND b.trade_date = c.trade_date))
SELECT x.*, a.rank AS current_rank, b.rank AS previous_rank FROM x LEFT JOIN r a ON a.symbol = x.symbol AND a.trade_date = x.trade_date LEFT JOIN r b ON b.symbol = x.symbol AND b.trade_date = x.previous_date""")
def holding_changes(spark, d):
    df = panel(spark, d)
    return rounded(sel.holding_changes(cs.top_k(df, "close", 3), df, "close"), "symbol", "trade_date", "previous_date", "kind", "current_rank", "previous_rank")


DIRECTED = f"""{FWD}, {LONG}, {ranked_sql('value', 'fwd', 'l', 'trade_date, factor')}, i AS (SELECT trade_date, factor, CASE WHEN count(a) >= 2 THEN {corr_sql('a', 'b')} END AS c FROM rk GROUP BY 1, 2),
m AS (SELECT *, CASE WHEN count(c) OVER w >= 6 THEN avg(c) OVER w END AS m0 FROM i WINDOW w AS (PARTITION BY factor ORDER BY trade_date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)), s AS (SELECT *, lag(m0) OVER (PARTITION BY factor ORDER BY trade_date) AS m FROM m),
dr AS (SELECT trade_date, factor, coalesce(last_value(CASE WHEN m >= 0.03 THEN 1 WHEN m <= -0.03 THEN -1 END IGNORE NULLS) OVER (PARTITION BY factor ORDER BY trade_date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 1) AS direction FROM s)"""


@query(f"WITH {DIRECTED} SELECT trade_date, factor, CAST(direction AS BIGINT) AS direction FROM dr")
def signal_directions(spark, d):
    ics = dg.factor_dates(forward(spark, d), ["pb", "volume"], "fwd")
    return rounded(sel.directions(ics, 20, 6, 0.03), "trade_date", "factor", "direction")


@query(f"""WITH {DIRECTED}, z AS (SELECT symbol, trade_date, factor, CASE WHEN stddev_pop(value) OVER g > 0 THEN (value - avg(value) OVER g) / stddev_pop(value) OVER g ELSE 0 END AS z FROM l WHERE value IS NOT NULL WINDOW g AS (PARTITION BY trade_date, factor)),
e AS (SELECT symbol, trade_date, sum(z * direction) / sum(abs(direction)) AS e FROM z JOIN dr USING (trade_date, factor) GROUP BY 1, 2) SELECT p.symbol, p.trade_date, {r6('e', 'ensemble')} FROM panel p LEFT JOIN e USING (symbol, trade_date)""")
def signal_ensemble(spark, d):
    df = forward(spark, d)
    ways = sel.directions(dg.factor_dates(df, ["pb", "volume"], "fwd"), 20, 6, 0.03)
    return rounded(sel.ensemble(df, ["pb", "volume"], ways.withColumn("strength", F.col("direction").cast("double"))), "symbol", "trade_date", "ensemble")


@query(f"""WITH {PANEL_SQL}, b AS (SELECT symbol, trade_date, close, row_number() OVER (PARTITION BY trade_date ORDER BY close DESC, symbol) AS r FROM panel WHERE close IS NOT NULL QUALIFY r <= 6),
z AS (SELECT *, exp(CASE WHEN stddev_pop(close) OVER d > 0 THEN (close - avg(close) OVER d) / stddev_pop(close) OVER d ELSE 0 END) AS w, count(*) OVER d AS n FROM b WINDOW d AS (PARTITION BY trade_date)),
s AS (SELECT *, (1 - 0.3 * (r - 1)) / sum(w) OVER (PARTITION BY trade_date ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS scale FROM z),
k AS (SELECT *, min(CASE WHEN w * scale <= 0.3 + 1e-12 THEN r END) OVER (PARTITION BY trade_date) AS uncut FROM s),
v AS (SELECT *, CASE WHEN uncut IS NULL THEN 1.0 / n WHEN r < uncut THEN 0.3 ELSE w * max(CASE WHEN r = uncut THEN scale END) OVER (PARTITION BY trade_date) END AS weight FROM k)
SELECT symbol, trade_date, {r6('weight')} FROM v""")
def softmax_weights(spark, d):
    return rounded(sel.softmax_weights(panel(spark, d), "close", 6, 0.3), "symbol", "trade_date", "weight")


@query("""WITH s AS (SELECT user_id, list(event_type ORDER BY event_id) AS base, CASE WHEN user_id % 3 = 0 THEN list(event_type ORDER BY event_id DESC) END AS own FROM events GROUP BY user_id) SELECT user_id, CAST(unnest(generate_series(1, len(coalesce(own, base)))) AS BIGINT) AS place, unnest(coalesce(own, base)) AS choice FROM s""")
def exploded_rankings(spark, d):
    return _exploded_rankings(table(spark, d, "events"))


def _exploded_rankings(events):
    e = events.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", "event_type"))).alias("x"))
    base = F.transform("x", lambda v: v["event_type"])
    e = e.select("user_id", base.alias("base"), F.when(F.col("user_id") % 3 == 0, F.reverse(base)).alias("own"))
    return rounded(sel.exploded_rankings(e, ["own", "base"], ["user_id"], "choice"), "user_id", "place", "choice")


@query("""SELECT CAST(p_partkey AS BIGINT) AS p_partkey, CASE WHEN p_type = 'STANDARD BRASS' THEN 'exact' WHEN contains(p_type, 'BRASS') THEN 'metal' WHEN contains(p_type, 'PROMO') THEN 'promotion' END AS theme FROM part""")
def theme_classes(spark, d):
    rules = spark.createDataFrame([(1, "BRASS", "metal"), (2, "PROMO", "promotion"), (9, "STANDARD BRASS", "exact")], "priority int, pattern string, label string")
    df = sel.classified(table(spark, d, "part").select(F.col("p_partkey").cast("long").alias("p_partkey"), "p_type"), "p_type", rules, "theme")
    return df.select("p_partkey", "theme")
