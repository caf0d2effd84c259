"""Labels: forward returns and ranks, tradable entries and exits, barriers, outcomes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomspark.functions import recipes as R
from loomspark.operators.joins import future_date, lookup
from loomspark.operators.panel import PANEL, Panel, away_from_limit, known_false


def forward_rank(df: DataFrame, price: str, days: int, panel: Panel = PANEL) -> DataFrame:
    """The return over the next rows, its percent rank by date, and the date on which it is known."""
    h = panel.history()
    df = df.withColumn("forward_return", R.ratio(F.lead(price, days).over(h), price) - 1).withColumn("label_end", F.lead(panel.date, days).over(h))
    return df.withColumn("forward_rank", R.percent_rank("forward_return", [panel.date]))


def blended_forward_rank(df: DataFrame, price: str, weights: dict[int, float], panel: Panel = PANEL) -> DataFrame:
    """The weighted mean of forward ranks of several horizons, where all are known."""
    h, total = panel.history(), sum(weights.values())
    for n in weights:
        df = df.withColumn(f"_f{n}", R.ratio(F.lead(price, n).over(h), price) - 1)
    df = df.withColumns({f"_r{n}": R.percent_rank(f"_f{n}", [panel.date]) for n in weights})
    blend = sum((F.col(f"_r{n}") * (w / total) for n, w in weights.items()), F.lit(0.0))
    return df.withColumn("blended_rank", blend).withColumn("label_end", F.lead(panel.date, max(weights)).over(h)).drop(*(f"_{k}{n}" for n in weights for k in "fr"))


def next_open(df: DataFrame, open_price: str, horizons: dict[int, float], up: str, down: str, suspended: str, eligible: str, panel: Panel = PANEL) -> DataFrame:
    """Returns from the next session's open to that of later ones, ranked among eligible rows and blended.

    An entry at its upper limit, an exit at its lower one, and suspended sessions give no label.
    """
    total = sum(horizons.values())
    buyable = away_from_limit(open_price, up, "buy") & known_false(suspended) & (F.col(open_price) > 0)
    sellable = away_from_limit(open_price, down, "sell") & known_false(suspended) & (F.col(open_price) > 0)
    df = df.withColumn("_in", F.when(buyable, F.col(open_price))).withColumn("_out", F.when(sellable, F.col(open_price)))
    df = lookup(future_date(df, 1, "entry_date", panel), "_in", "entry_date", "_entry", panel)
    for n in horizons:
        df = lookup(future_date(df, n + 1, f"exit_date_{n}", panel), "_out", f"exit_date_{n}", f"_exit_{n}", panel)
        df = df.withColumn(f"open_return_{n}", F.when(F.col(eligible), R.ratio(f"_exit_{n}", "_entry") - 1)).drop(f"_exit_{n}")
    df = df.withColumns({f"open_rank_{n}": R.percent_rank(f"open_return_{n}", [panel.date]) for n in horizons})
    return df.withColumn("open_label", sum((F.col(f"open_rank_{n}") * (w / total) for n, w in horizons.items()), F.lit(0.0))).drop("_in", "_out", "_entry")


def triple_barrier(prices: DataFrame, events: DataFrame, horizon: int, profit: float, loss: float, least_target: float = 0.0, price: str = "close", panel: Panel = PANEL) -> DataFrame:
    """Each event with the first of its barriers that its path touches: profit, loss, or the end of the horizon.

    events: event_id, entity, date, target, side (1 or -1). A path is the next ``horizon`` rows of the entity; a
    profit taken and a loss stopped at once count as profit; at the end the sign of the return decides. Events without
    a price, target or later row get no label.
    """
    ahead = panel.history().rowsBetween(1, horizon)
    paths = prices.select(*panel.keys, F.col(price).alias("_entry"), F.collect_list(F.struct(F.col(panel.date).alias("d"), F.col(price).alias("p"))).over(ahead).alias("_path"))
    begun = events.filter(F.col("target") > least_target).join(paths, panel.keys)

    def touched(x, k):
        r = (R.ratio(x["p"], "_entry") - 1) * F.col("side")
        kind = F.when(r >= profit * F.col("target"), "profit_taking").when(r <= -loss * F.col("target"), "stop_loss").when(k == horizon - 1, "vertical")
        return F.struct(kind.alias("barrier"), x["d"].alias("touched"), r.alias("side_return"))

    first = begun.withColumn("x", F.get(F.filter(F.transform("_path", touched), lambda x: x["barrier"].isNotNull()), F.lit(0)))
    label = F.when(F.col("barrier") == "profit_taking", 1).when(F.col("barrier") == "stop_loss", -1).when(F.col("barrier") == "vertical", F.signum("side_return").cast("int"))
    return first.select("event_id", panel.entity, panel.date, "x.*").withColumn("label", label).filter("barrier is not null")


def meta_label(df: DataFrame, outcome: str, out: str = "meta_label") -> DataFrame:
    """1 for a gain, 0 for none, NULL for an unknown outcome."""
    return df.withColumn(out, F.when(F.col(outcome).isNotNull(), (F.col(outcome) > 0).cast("int")))


def bet_size(probability: str, side: str | None = None, step: float | None = None):
    """A probability of two classes as a position: 2 * Phi(z) - 1, by the logistic form of Phi, in steps if asked for."""
    p = R.clip(F.col(probability), 1e-6, 1 - 1e-6)
    z = (p - 0.5) / F.sqrt(p * (1 - p))
    t = 1 / (1 + F.abs(z) * 0.2316419)
    # fixed values: the polynomial of the normal distribution's upper tail
    tail = F.exp(-z * z / 2) / F.sqrt(F.lit(2.0) * F.pi()) * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    size = F.signum(z) * (1 - 2 * tail)
    size = size * F.col(side) if side else size
    return F.rint(size / step) * step if step else size


def quarterly(df: DataFrame, flows: list[str], entity: str, period: str, available: str) -> DataFrame:
    """Flows of each quarter alone, from sums of the year so far. A first quarter stands as it is; others need the one
    before. Of several versions of a period the first known value counts."""
    first = df.groupBy(entity, period).agg(F.min(available).alias(available), *(F.min_by(f, F.when(F.col(f).isNotNull(), F.col(available))).alias(f) for f in flows))
    w = Window.partitionBy(entity, F.year(period)).orderBy(period)
    next_to = F.quarter(F.lag(period).over(w)) == F.quarter(period) - 1
    return first.withColumns({f"{f}_q": F.when(F.quarter(period) == 1, F.col(f)).when(next_to, F.col(f) - F.lag(f).over(w)) for f in flows})


def stability(df: DataFrame, value: str, entity: str, period: str, quarters: int = 12, least: int = 8, positive: int = 10) -> DataFrame:
    """Of the last quarters: how many, whether they follow one another, median, deviation, share above zero, and a
    strict flag, NULL where too few are known."""
    index = F.year(period) * 4 + F.quarter(period)
    w = R.rows([entity], [period], quarters)
    df = df.withColumn("_q", index)
    n, up = F.count(value).over(w), F.count(F.when(F.col(value) > 0, 1)).over(w)
    gapless = (F.max("_q").over(w) - F.min("_q").over(w) == quarters - 1) & (F.count(F.lit(1)).over(w) == quarters)
    df = df.withColumn("n_known", n).withColumn("gapless", gapless).withColumn("n_positive", up)
    df = df.withColumn("median", F.when(n >= least, R.rolling_median(value, w))).withColumn("deviation", F.when(n >= least, F.stddev_pop(value).over(w))).drop("_q")
    return df.withColumn("strict", F.when((F.col("n_known") >= least) & F.col("gapless"), F.col("n_positive") >= positive))
