"""Sample weights and uniqueness of labels that overlap in time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomspark.functions import recipes as R
from loomspark.operators.panel import PANEL, Panel, calendar


def date_equal(df: DataFrame, out: str = "weight", panel: Panel = PANEL) -> DataFrame:
    """One over the number of rows of the date."""
    return df.withColumn(out, 1 / F.count(F.lit(1)).over(R.by(panel.date)))


def decayed(df: DataFrame, halflife: float, out: str = "weight", panel: Panel = PANEL) -> DataFrame:
    """Half the weight for each ``halflife`` dates of age, one on average."""
    days = calendar(df, panel)
    last = days.agg(F.max("position").alias("_last"))
    placed = df.join(F.broadcast(days), panel.date).join(F.broadcast(last), how="left")  # one row
    raw = placed.withColumn(out, F.pow(F.lit(0.5), (F.col("_last") - F.col("position")) / halflife)).drop("_last", "position")
    mean = raw.agg(F.avg(out).alias("_mean"))
    return raw.join(F.broadcast(mean), how="left").withColumn(out, F.col(out) / F.col("_mean")).drop("_mean")


def concurrency(events: DataFrame, bars: DataFrame, start: str, end: str, group: str) -> DataFrame:
    """For each bar how many events of its group are open: a running sum of beginnings and ends.

    events: group, start, end (inclusive); bars: group, bar. Bars without events have 0.
    """
    steps = events.select(group, F.col(start).alias("bar"), F.lit(1).alias("step"), F.lit(0).alias("kind")).union(events.select(group, F.col(end), F.lit(-1), F.lit(2)))
    marks = bars.select(group, "bar", F.lit(0).alias("step"), F.lit(1).alias("kind"))
    w = Window.partitionBy(group).orderBy("bar", "kind").rowsBetween(Window.unboundedPreceding, 0)
    return steps.union(marks).withColumn("concurrency", F.sum("step").over(w)).filter("kind = 1").select(group, "bar", "concurrency")


def average_uniqueness(events: DataFrame, bars: DataFrame, start: str, end: str, group: str) -> DataFrame:
    """Events with the mean over their bars of one over the concurrency, and the number of their bars.

    Running sums over the bars give each event's total as a difference of two, without a row for each bar of it.
    """
    open_bars = concurrency(events, bars, start, end, group)
    w = Window.partitionBy(group).orderBy("bar").rowsBetween(Window.unboundedPreceding, 0)
    sums = open_bars.withColumn("_s", F.sum(F.when(F.col("concurrency") > 0, 1 / F.col("concurrency")).otherwise(0.0)).over(w)).withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy("bar")))
    at = Window.partitionBy(group).orderBy("bar", "kind").rowsBetween(Window.unboundedPreceding, 0)
    points = sums.select(group, "bar", F.lit(1).alias("kind"), F.struct("_s", "_n").alias("v"), F.lit(None).cast("struct<id: string, first: boolean>").alias("e"))
    keyed = events.withColumn("_id", F.sha2(F.to_json(F.struct("*")), 256))
    ends = keyed.select(group, F.col(end).alias("bar"), F.lit(2).alias("kind"), F.lit(None).cast(points.schema["v"].dataType).alias("v"), F.struct(F.col("_id").alias("id"), F.lit(False).alias("first")).alias("e"))
    begins = keyed.select(group, F.col(start).alias("bar"), F.lit(0).alias("kind"), F.lit(None).cast(points.schema["v"].dataType).alias("v"), F.struct(F.col("_id").alias("id"), F.lit(True).alias("first")).alias("e"))
    seen = points.union(begins).union(ends).withColumn("x", F.last("v", ignorenulls=True).over(at)).filter("kind <> 1")
    zero = F.struct(F.lit(0.0).alias("_s"), F.lit(0).alias("_n"))
    both = seen.select(F.col("e.id").alias("_id"), F.col("e.first").alias("first"), F.coalesce("x", zero).alias("x")).groupBy("_id").agg(F.max(F.when(F.col("first"), F.col("x"))).alias("a"), F.max(F.when(~F.col("first"), F.col("x"))).alias("b"))
    n = F.col("b._n") - F.col("a._n")
    return keyed.join(both, "_id").withColumn("n_bars", n.cast("long")).withColumn("uniqueness", R.ratio(F.col("b._s") - F.col("a._s"), F.nullif(n, F.lit(0)))).drop("_id", "a", "b")
