"""Random procedures whose draws are hashes: the same rows give the same draws, on any cluster and in any order.

A draw depends on a seed and on columns of the row itself, so that it needs neither a generator's state nor a
partition's number, and a task that runs again repeats it.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspark.functions import recipes as R
from loomspark.operators import diagnostics as dg
from loomspark.operators.features import shifted_target
from loomspark.operators.panel import PANEL, Panel, require


def draw(seed: int, *columns: str | Column) -> Column:
    """A number from 0 to below 1 by seed and columns: 52 bits of the MD5 of their spellings. NULLs are left out."""
    spelt = F.concat_ws("|", F.lit(str(seed)), *(R.col(c).cast("string") for c in columns))
    return F.conv(F.substring(F.md5(spelt), 1, 13), 16, 10).cast("double") / float(1 << 52)


def random_feature(df: DataFrame, seed: int, out: str = "random", panel: Panel = PANEL) -> DataFrame:
    """A column that says nothing: an even draw for each key."""
    return df.withColumn(out, draw(seed, *panel.keys))


def random_universe(df: DataFrame, share: float, seed: int, panel: Panel = PANEL) -> DataFrame:
    """The whole histories of about this share of the entities."""
    return df.filter(draw(seed, panel.entity) < share)


def negative_controls(
    df: DataFrame, features: Sequence[str], target: str, shift: int = 1, random_features: int = 3, share: float = 0.5, seed: int = 42, sentinels: Sequence[str] = (), panel: Panel = PANEL, by_date: Callable[[DataFrame], DataFrame] = lambda df: df
) -> DataFrame:
    """control, n, mean, std, ir, t_stat of daily rank correlations that should, or should not, tell something.

    baseline: the mean of the known features with the target; shifted_label: with the target ``shift`` rows later;
    random_feature_k: draws in place of features; random_universe: a share of the entities; each sentinel by its
    name. A control without any defined date has n 0 and NULLs. by_date: how rows that a history has moved are dealt to
    tasks by date again.
    """
    require(df, [*panel.keys, *features, target, *sentinels])
    proxy = df.withColumn("_proxy", R.mean_of([R.col(f) for f in features]))
    trials = {
        "baseline": (proxy, "_proxy", target),
        "shifted_label": (by_date(shifted_target(proxy, target, shift, "_later", panel).select(*panel.keys, "_proxy", "_later")), "_proxy", "_later"),
        **{f"random_feature_{k}": (random_feature(df, seed + k, "_random", panel), "_random", target) for k in range(random_features)},
        "random_universe": (random_universe(proxy, share, seed, panel), "_proxy", target),
        **{s: (df, s, target) for s in sentinels},
    }
    found = [dg.summarize_ic(dg.daily_ic(rows, x, y, panel=panel)).withColumn("control", F.lit(name)) for name, (rows, x, y) in trials.items()]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.select("control", "n", "mean", "std", "ir", "t_stat")


def permuted_ic(df: DataFrame, score: str, target: str, runs: int, seed: int = 42, panel: Panel = PANEL) -> DataFrame:
    """run, n_dates, mean_ic: the mean daily rank correlation with targets dealt anew within each date.

    Run 0 has the targets as they are. Rows without score or target are left out. Each run has all rows: the work
    grows with their number, all of it grouped by run and date.
    """
    known = df.filter(F.col(score).isNotNull() & F.col(target).isNotNull()).select(*panel.keys, score, target)
    # ranks go with the targets, so that they are the same in each run
    ranked = dg.with_ranks(known, [(score, target)], [panel.date]).select(*panel.keys, "_a0", "_b0")
    place = F.row_number().over(Window.partitionBy(panel.date).orderBy(panel.entity))
    each = ranked.withColumn("_place", place).withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(runs))))
    dealt = F.when(F.col("run") == 0, F.lit(0.0)).otherwise(draw(seed, "run", *panel.keys))
    each = each.withColumn("_dealt", F.row_number().over(Window.partitionBy("run", panel.date).orderBy(dealt, "_place")))
    # a place gets its score's rank from one row and its target's from another, both of the date: no row leaves the task
    either = F.array(F.struct(F.col("_place").alias("at"), F.col("_a0").alias("a")), F.struct(F.col("_dealt").alias("at"), F.lit(None).cast("double").alias("a")))
    target_of = F.when(F.col("_half") == 1, F.col("_b0"))
    halves = each.select("run", panel.date, "_b0", F.posexplode(either).alias("_half", "_x")).select("run", panel.date, "_x.at", "_x.a", target_of.alias("b"))
    again = halves.groupBy(panel.date, "run", "at").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    ics = again.groupBy(panel.date, "run").agg(R.pearson("a", "b").alias("ic"))
    return ics.groupBy("run").agg(F.count("ic").alias("n_dates"), F.avg("ic").alias("mean_ic"))


def permutation_test(runs: DataFrame) -> DataFrame:
    """observed, mean, std, runs, p_value (of a mean at least as great) of what permuted_ic gives."""
    observed, dealt = F.max(F.when(F.col("run") == 0, F.col("mean_ic"))), F.when(F.col("run") > 0, F.col("mean_ic"))
    found = runs.select("run", "mean_ic", observed.over(Window.partitionBy()).alias("observed"))  # a row a run
    above = F.sum(((F.col("run") > 0) & (F.col("mean_ic") >= F.col("observed"))).cast("long"))
    return found.agg(
        F.max("observed").alias("observed"), F.avg(dealt).alias("mean"), F.stddev_samp(dealt).alias("std"), F.count(dealt).alias("runs"), ((above + 1) / (F.count(dealt) + 1)).alias("p_value")
    )


def block_bootstrap(series: DataFrame, value: str, date: str, scenarios: int = 100, block: int = 5, per_year: float | None = None, seed: int = 42) -> DataFrame:
    """scenario, n, total_return, mean_return, sharpe, max_drawdown of paths made of blocks of a series of returns.

    The series has one row a date. Blocks begin at drawn places and go on at the beginning when they reach the end,
    so that each place is as likely; paths are as long as the series. Missing returns are left out; returns are
    above -1.
    """
    known = series.filter(F.col(value).isNotNull()).select(date, F.col(value).cast("double").alias("_r"))
    n = F.count(F.lit(1)).over(Window.partitionBy())
    placed = known.select((F.row_number().over(Window.orderBy(date)) - 1).alias("_at"), n.alias("_n"), "_r")
    steps = placed.select("_n", F.col("_at").alias("step"), F.explode(F.sequence(F.lit(0), F.lit(scenarios - 1))).alias("scenario"))
    start = F.floor(draw(seed, "scenario", F.floor(F.col("step") / block)) * F.col("_n"))
    steps = steps.withColumn("_at", F.pmod(start + F.pmod(F.col("step"), F.lit(block)), F.col("_n")).cast("int"))
    path = steps.select("scenario", "step", "_at").join(F.broadcast(placed.select("_at", "_r")), "_at")  # a row a date
    w = Window.partitionBy("scenario").orderBy("step")
    path = path.withColumn("_level", F.sum(F.log1p("_r")).over(w))
    path = path.withColumn("_fall", F.exp(F.col("_level") - F.max("_level").over(w)) - 1)
    spread, mean = F.nullif(F.stddev_samp("_r"), F.lit(0.0)), F.avg("_r")
    return path.groupBy("scenario").agg(
        F.count("_r").alias("n"),
        (F.exp(F.sum(F.log1p("_r"))) - 1).alias("total_return"),
        mean.alias("mean_return"),
        (R.ratio(mean, spread) * (per_year or 1.0) ** 0.5).alias("sharpe"),
        F.min("_fall").alias("max_drawdown"),
    )
