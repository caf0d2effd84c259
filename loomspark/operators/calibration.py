"""Probabilities from scores, fitted for each date on the strictly earlier dates: isotonic steps or Platt's logistic curve.

A score is taken to a fixed number of decimals, so that all that a fit needs is how many rows and how many positive ones
each such step has. Dates go in blocks: the steps' counts of all earlier blocks are summed up for each block, which then
adds its own dates one after the other. A block holds a row for each step and date, whatever the size of the panel.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomspark.functions import recipes as R
from loomspark.operators.panel import PANEL, Panel, calendar

METHODS = ("isotonic", "platt")


def isotonic(n: np.ndarray, s: np.ndarray) -> np.ndarray:
    """The ascending values nearest to the means s / n, weighted by n > 0: neighbours that descend are pooled."""
    size, total, count = [], [], []
    for a, b in zip(n.tolist(), s.tolist()):
        k = 1
        while total and total[-1] * a >= b * size[-1]:
            a, b, k = a + size.pop(), b + total.pop(), k + count.pop()
        size.append(a)
        total.append(b)
        count.append(k)
    return np.repeat(np.array(total) / np.array(size), count)


def platt(x: np.ndarray, n: np.ndarray, s: np.ndarray, penalty: float = 1.0, rounds: int = 100) -> tuple[float, float]:
    """Intercept and slope of the logistic curve that fits s of n at x, by Newton's steps; the slope alone is penalised
    by half its square."""
    b = np.array([np.log(s.sum() / (n.sum() - s.sum())), 0.0])

    def loss(b):
        z = b[0] + b[1] * x
        return float((n * np.logaddexp(0, z) - s * z).sum() + penalty * b[1] ** 2 / 2)

    at = loss(b)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(b[0] + b[1] * x)))
        slope = np.array([(s - n * p).sum(), (x * (s - n * p)).sum() - penalty * b[1]])
        w = n * p * (1 - p)
        curve = np.array([[w.sum(), (w * x).sum()], [(w * x).sum(), (w * x * x).sum() + penalty]])
        step = np.linalg.solve(curve, slope)
        while (new := loss(b + step)) > at + 1e-12 and np.abs(step).max() > 1e-14:
            step /= 2
        b, at = b + step, new
        if np.abs(step).max() < 1e-12:
            break
    return float(b[0]), float(b[1])


def steps(score, digits: int):
    """The number of the score's step."""
    return F.round(R.clean(score) * 10**digits + 1e-9).cast("long")


def expanding(df: DataFrame, score: str, outcome: str, method: str = "isotonic", digits: int = 4, least: int = 200, block: int = 64, out: str = "calibrated", panel: Panel = PANEL) -> DataFrame:
    """df with the probability of outcome 1 at each row's score, by a fit of the rows of strictly earlier dates.

    Only outcomes of 0 and 1 are learnt from. The probability is NULL where the score is, and until ``least`` of them,
    of both kinds, are known. isotonic: between two steps that were seen it is on the line between them, and beyond
    them that of the last one. platt: a logistic curve with a slope penalised by half its square.
    """
    if method not in METHODS:
        raise ValueError(f"method must be one of {METHODS}")
    day = panel.date
    keyed = df.withColumn("_k", steps(score, digits))
    days = calendar(df, panel).withColumn("_block", F.expr(f"cast(position as long) div {block}")).select(day, "_block")
    known = keyed.filter(F.col("_k").isNotNull() & F.col(outcome).isin(0, 1))
    cells = known.groupBy(day, "_k").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(outcome).cast("long")).alias("s")).join(days, day)
    blocks = cells.groupBy("_block", "_k").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    last = days.agg(F.max("_block")).first()[0]
    after = F.explode(F.when(F.col("_block") < F.lit(last), F.sequence(F.col("_block") + 1, F.lit(last).cast("long"))))
    before = blocks.withColumn("_after", after).groupBy(F.col("_after").alias("_block"), "_k").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    asked = keyed.filter("_k is not null").select(day, "_k").distinct().join(days, day)
    rows = before.select("_block", F.lit(None).cast(df.schema[day].dataType).alias(day), "_k", "n", "s")
    rows = rows.unionByName(cells.select("_block", day, "_k", "n", "s")).unionByName(asked.select("_block", day, "_k", F.lit(None).cast("long").alias("n"), F.lit(None).cast("long").alias("s")))

    def fold(part: pd.DataFrame) -> pd.DataFrame:
        keys = np.unique(part["_k"].to_numpy(np.int64))
        n, s = np.zeros(len(keys)), np.zeros(len(keys))

        def add(rows: pd.DataFrame) -> None:
            at = np.searchsorted(keys, rows["_k"].to_numpy(np.int64))
            np.add.at(n, at, rows["n"].to_numpy(float))
            np.add.at(s, at, rows["s"].to_numpy(float))

        add(part[part[day].isna()])
        found = []
        for date, rows in part[part[day].notna()].groupby(day, sort=True):
            asked = rows[rows["n"].isna()]["_k"].to_numpy(np.int64)
            seen = n > 0
            if len(asked) and n.sum() >= least and 0 < s.sum() < n.sum():
                if method == "isotonic":
                    p = np.interp(asked, keys[seen], isotonic(n[seen], s[seen]))
                else:
                    a, b = platt(keys[seen] / 10**digits, n[seen], s[seen])
                    p = 1 / (1 + np.exp(-(a + b * asked / 10**digits)))
                found.append(pd.DataFrame({day: date, "_k": asked, out: p}))
            add(rows[rows["n"].notna()])
        return pd.concat(found) if found else pd.DataFrame({day: pd.Series([], dtype=object), "_k": [], out: []})

    fits = rows.groupBy("_block").applyInPandas(fold, f"{day} {df.schema[day].dataType.simpleString()}, _k long, {out} double")
    return keyed.join(fits, [day, "_k"], "left").drop("_k")


def brier(df: DataFrame, score: str, outcome: str, calibrated: str = "calibrated", digits: int = 4, panel: Panel = PANEL) -> DataFrame:
    """observations, calibration_windows, brier_before, brier_after: the mean squared error of the score's percent rank
    among all rows that have a probability, and of the probability.

    Ranks are counted within steps of the score, after the rows of all steps below: no task orders the whole panel.
    """
    full = df.filter(F.col(score).isNotNull() & F.col(outcome).isNotNull() & F.col(calibrated).isNotNull()).withColumn("_k", steps(score, digits))
    below = full.groupBy("_k").agg(F.count(F.lit(1)).alias("_n"))
    all_steps = Window.orderBy("_k")  # a row a step
    below = below.select("_k", (F.sum("_n").over(all_steps) - F.col("_n")).alias("_below"), F.sum("_n").over(all_steps.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_all"))
    ranked = full.withColumn("_r", R.average_rank(score, ["_k"])).join(below, "_k")
    raw = (F.col("_r") + F.col("_below")) / F.col("_all")
    error = lambda p: F.avg((p - F.col(outcome)) * (p - F.col(outcome)))
    return ranked.agg(F.count(F.lit(1)).alias("observations"), F.countDistinct(panel.date).alias("calibration_windows"), error(raw).alias("brier_before"), error(F.col(calibrated)).alias("brier_after"))
