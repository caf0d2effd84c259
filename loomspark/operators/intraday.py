"""Measures of a day from its bars: one aggregation per entity and date."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomspark.functions import recipes as R
from loomspark.operators.panel import PANEL, Panel


def day_measures(bars: DataFrame, bar: str = "bar_time", open_until: str = "10:00:00", late_from: str = "14:30:00", first_bar: str = "09:35:00", panel: Panel = PANEL) -> DataFrame:
    """Volatility, range, volume shares and concentration of each entity and date.

    bars: bar (a 'HH:mm:ss' string), open, high, low, close, volume. Returns are from bar to bar; those of bars
    before the first count as unknown.
    """
    w = Window.partitionBy(*panel.keys).orderBy(bar)
    rows = bars.withColumn("ret", F.when(F.col(bar) >= first_bar, R.pct_change("close", w)))
    share = lambda when: R.ratio(F.sum(F.when(when, F.col("volume"))), F.nullif(F.sum("volume"), F.lit(0.0)))
    first_open, last_close = F.min_by("open", bar), F.max_by("close", bar)
    late_open = F.min_by(F.when(F.col(bar) >= late_from, F.col("close")), F.when(F.col(bar) >= late_from, F.col(bar)))
    spread = F.max("high") - F.min("low")
    squares = F.sum(F.col("volume") * F.col("volume"))
    return rows.groupBy(*panel.keys).agg(
        F.sqrt(F.sum(F.col("ret") * F.col("ret"))).alias("realized_vol"),
        F.sqrt(F.sum(F.when(F.col("ret").isNotNull(), F.pow(F.least("ret", F.lit(0.0)), F.lit(2.0))))).alias("downside_vol"),
        R.ratio(spread, F.nullif(first_open, F.lit(0.0))).alias("range_over_open"),
        R.ratio(last_close - F.min("low"), F.nullif(spread, F.lit(0.0))).alias("close_location"),
        (R.ratio(last_close, F.nullif(late_open, F.lit(0.0))) - 1).alias("late_return"),
        share(F.col(bar) <= open_until).alias("open_volume_share"),
        share(F.col(bar) >= late_from).alias("late_volume_share"),
        R.ratio(squares, F.nullif(F.pow(F.sum("volume"), F.lit(2.0)), F.lit(0.0))).alias("volume_hhi"),
        F.avg((F.col("volume") > 0).cast("double")).alias("active_ratio"),
        R.pearson("volume", "ret").alias("volume_return_corr"),
        R.ratio(F.stddev_samp("volume"), F.nullif(F.avg("volume"), F.lit(0.0))).alias("volume_cv"),
        F.count(F.lit(1)).alias("n_bars"),
    )


def peak_measures(bars: DataFrame, expected_bars: int = 240, panel: Panel = PANEL) -> DataFrame:
    """Volume regularity, realised and jump variance, and volume peaks of each entity and date, with diagnostics.

    bars: bar_index, open, close, volume. A day with any bar twice has no measures at all, but is diagnosed. The
    first bar's return is from its open; others need the bar before to be the one before in number.
    """
    keys = panel.keys
    day = R.by(*keys)
    diagnosed = bars.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.countDistinct("bar_index").alias("n_bars"),
        (F.count("bar_index") - F.countDistinct("bar_index")).alias("n_duplicates"),
        F.count(F.when(F.coalesce(F.col("close") <= 0, F.lit(True)), 1)).alias("n_bad_prices"),
        F.count(F.when(F.coalesce(F.col("volume") < 0, F.lit(True)), 1)).alias("n_bad_volumes"),
    )
    one = bars.withColumn("nth", F.row_number().over(Window.partitionBy(*keys, "bar_index").orderBy("open", "close", "volume"))).filter("nth = 1")
    w = Window.partitionBy(*keys).orderBy("bar_index")
    v = F.when(F.col("volume") > 0, F.col("volume"))
    near = F.lag("bar_index").over(w) == F.col("bar_index") - 1
    ret = F.when(near, F.log(R.ratio("close", F.lag("close").over(w)))).otherwise(F.when(F.row_number().over(w) == 1, F.log(R.ratio("close", "open"))))
    rows = one.withColumn("v", v).withColumn("r", ret).withColumn("jump", F.abs(F.lag("v").over(w) - F.col("v"))).withColumn("pair", F.when(near, F.abs(F.col("r")) * F.abs(F.lag("r").over(w))))
    rows = rows.withColumn("mean", F.avg("v").over(day)).withColumn("sd", F.stddev_pop("v").over(day))
    for k in (1, 2):
        above = F.coalesce(F.col("v") > F.col("mean") + k * F.col("sd"), F.lit(False))
        rows = rows.withColumn(f"above{k}", above).withColumn(f"rises{k}", (F.col(f"above{k}") & ~F.lag(f"above{k}", 1, False).over(w)).cast("int"))
    n = F.count("r")
    values = rows.groupBy(*keys).agg(
        R.ratio(F.stddev_pop("v"), F.avg("v")).alias("volume_cv"),
        F.stddev_pop(F.log("v")).alias("log_volume_sd"),
        R.ratio(F.avg("jump"), F.avg("v")).alias("volume_diff"),
        F.sum(F.col("r") * F.col("r")).alias("rv"),
        F.sum(F.when(F.col("r") < 0, F.col("r") * F.col("r")).otherwise(F.when(F.col("r").isNotNull(), 0.0))).alias("rv_down"),
        F.when(F.count("pair") > 0, F.lit(math.pi / 2) * F.sum("pair") * R.ratio(n, F.count("pair"))).alias("bipower"),
        F.sum("rises1").alias("peaks_1"),
        F.sum("rises2").alias("peaks_2"),
    )
    whole = diagnosed.join(values, keys, "left").withColumn("coverage", F.col("n_bars") / F.lit(float(expected_bars)))
    whole = whole.withColumn("downside_share", R.ratio("rv_down", F.nullif(F.col("rv"), F.lit(0.0)))).withColumn("jump_share", R.ratio(F.greatest(F.col("rv") - F.col("bipower"), F.lit(0.0)), F.nullif(F.col("rv"), F.lit(0.0))))
    measured = ["volume_cv", "log_volume_sd", "volume_diff", "rv", "rv_down", "bipower", "peaks_1", "peaks_2", "downside_share", "jump_share"]
    return whole.withColumns({c: F.when(F.col("n_duplicates") == 0, F.col(c)) for c in measured})


def morning_vwap(bars: DataFrame, bars_of_open: int = 1, price: str = "close", volume: str = "volume", panel: Panel = PANEL) -> DataFrame:
    """The volume-weighted price of each day's first bars."""
    w = Window.partitionBy(*panel.keys).orderBy("bar_index", price, volume)
    first = bars.withColumn("nth", F.row_number().over(w)).filter(F.col("nth") <= bars_of_open)
    return first.groupBy(*panel.keys).agg(R.ratio(F.sum(F.col(price) * F.col(volume)), F.nullif(F.sum(volume), F.lit(0.0))).alias("vwap"))


def volume_shares(bars: DataFrame, buckets: int, length: int, volume: str = "volume", panel: Panel = PANEL) -> DataFrame:
    """The share of the day's volume in each of some equal spans of bar numbers, 0 where there is none."""
    bucket = F.least(F.floor(F.col("bar_index") * buckets / length), F.lit(buckets - 1)).cast("int")
    total = F.nullif(F.sum(volume), F.lit(0.0))
    return bars.withColumn("_b", bucket).groupBy(*panel.keys).agg(*(F.coalesce(R.ratio(F.sum(F.when(F.col("_b") == k, F.col(volume))), total), F.lit(0.0)).alias(f"share_{k}") for k in range(buckets)))


def smart_money(bars: DataFrame, beta: float = 0.1, threshold: float = 0.2, panel: Panel = PANEL) -> DataFrame:
    """The volume-weighted price of the bars that move most for their volume, up to a share of the day's, over that of all."""
    w = Window.partitionBy(*panel.keys).orderBy("bar_index", "close", "volume")
    moved = bars.withColumn("_s", R.ratio(F.abs(R.pct_change("close", w)), F.nullif(F.pow("volume", F.lit(beta)), F.lit(0.0)))).filter("_s is not null")
    order = Window.partitionBy(*panel.keys).orderBy(F.col("_s").desc(), "bar_index", "close", "volume").rowsBetween(Window.unboundedPreceding, 0)
    moved = moved.withColumn("_c", F.sum("volume").over(order)).withColumn("_t", F.sum("volume").over(R.by(*panel.keys)))
    smart = F.col("_c") <= threshold * F.col("_t")
    cost = lambda c: R.ratio(F.sum(F.when(c, F.col("close") * F.col("volume"))), F.nullif(F.sum(F.when(c, F.col("volume"))), F.lit(0.0)))
    return moved.groupBy(*panel.keys).agg(R.ratio(cost(smart), cost(F.lit(True))).alias("smart_money_q"))
