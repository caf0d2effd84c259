"""A model that ranks: weights of features by the listwise loss of each date's rows.

Within a date the model's scores give each row a probability to be the first, the softmax, and so do the labels'
grades; the loss is the cross entropy of the two, summed over dates, and half the squared weights times a penalty. It is
convex, and its gradient and curvature are sums over rows by date, then over dates: each of Newton's steps is two
aggregations of the panel, and only a row of sums comes to the driver.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.functions import recipes as R
from loomspark.operators.panel import PANEL, Panel, require

#: Grades of labels are whole numbers up to it.
MOST_GRADE = 31


@dataclass(frozen=True)
class Ranker:
    """Weights of standardised features, and what they were fitted on."""

    features: tuple[str, ...]
    weights: tuple[float, ...]
    means: tuple[float, ...]
    scales: tuple[float, ...]
    as_of: date | None
    rows: int
    dates: int
    train_start: date
    train_end: date
    rounds: int

    def contributions(self) -> list[Column]:
        """What each feature adds to a row's score; an unknown one adds nothing."""
        return [F.coalesce((R.clean(f) - m) * (w / s), F.lit(0.0)) if s else F.lit(0.0) for f, w, m, s in zip(self.features, self.weights, self.means, self.scales)]

    def score(self) -> Column:
        return sum(self.contributions(), F.lit(0.0))

    def predict(self, df: DataFrame, panel: Panel = PANEL) -> DataFrame:
        """date, entity, percentile, rank: the rows of each date by score, ties by entity. Scores themselves are not
        given: their height has no meaning across dates."""
        scored = df.select(*panel.keys, self.score().alias("_s"))
        return scored.select(*panel.keys, R.percent_rank("_s", [panel.date]).alias("percentile"), R.first_rank("_s", [panel.date], [panel.entity], descending=True).alias("rank"))

    def explain(self, df: DataFrame, panel: Panel = PANEL) -> DataFrame:
        """date, entity, and the contribution of each feature, as contribution_<feature>."""
        return df.select(*panel.keys, *(c.alias(f"contribution_{f}") for f, c in zip(self.features, self.contributions())))


def grades(label, most: int = MOST_GRADE) -> Column:
    """Whole grades of labels from 0 to 1, halves to the even one."""
    return F.bround(R.clip(R.clean(label), 0.0, 1.0) * most).cast("int")


def training_rows(df: DataFrame, features: Sequence[str], label: str, label_end: str, as_of: date | None = None, train_dates: int | None = None, least: int = 2, panel: Panel = PANEL) -> DataFrame:
    """The rows that a fit may see: labels known and ended by ``as_of``, of the last ``train_dates`` dates that have
    any, of dates with ``least`` rows at least."""
    require(df, [*panel.keys, *features, label, label_end])
    known = df.filter(F.col(label).isNotNull() & F.col(label_end).isNotNull())
    if as_of is not None:
        known = known.filter(F.col(label_end) <= F.lit(as_of))
    rows = known.select(*panel.keys, *(R.clean(f).alias(f) for f in features), grades(label).alias("_grade"), label_end)
    days = rows.groupBy(panel.date).agg(F.count(F.lit(1)).alias("_n"), F.sum("_grade").alias("_total"))
    if train_dates is not None:
        days = days.orderBy(F.desc(panel.date)).limit(train_dates)  # the training window is the feature
    return rows.join(days.filter(F.col("_n") >= least), panel.date)


def fit_listwise(df: DataFrame, features: Sequence[str], label: str, label_end: str, as_of: date | None = None, train_dates: int | None = None, least: int = 2, penalty: float = 1.0, tolerance: float = 1e-8, most_rounds: int = 50, panel: Panel = PANEL) -> Ranker:
    """The weights of the least loss. Labels are percent ranks from 0 to 1; dates whose grades are all 0 are left out.

    Features are standardised by the training rows; unknown ones count as the mean. Raises ValueError where there are no
    rows to train on, where a label ends before its own date, and where the weights have not settled after
    ``most_rounds`` steps.
    """
    if not df.filter(F.col(label_end) <= F.col(panel.date)).isEmpty():
        raise ValueError("labels must end after their dates")
    rows = training_rows(df, features, label, label_end, as_of, train_dates, least, panel).filter("_total > 0")
    f = len(features)
    about = rows.agg(*(F.avg(c) for c in features), *(F.stddev_pop(c) for c in features), F.count(F.lit(1)), F.countDistinct(panel.date), F.min(panel.date), F.max(panel.date)).first()
    if not about[2 * f]:
        raise ValueError("no labels to train on")
    means, scales = [x or 0.0 for x in about[:f]], [x or 0.0 for x in about[f : 2 * f]]
    z = [F.coalesce((F.col(c) - m) / s, F.lit(0.0)) if s else F.lit(0.0) for c, m, s in zip(features, means, scales)]
    share = (F.col("_grade") / F.col("_total")).alias("_t")
    table = rows.select(panel.date, share, *(x.alias(f"_z{k}") for k, x in enumerate(z))).persist()
    pairs = [(i, j) for i in range(f) for j in range(i, f)]
    column = lambda k: F.col(f"_z{k}")

    def sums(w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Loss, gradient and curvature at weights w."""
        scored = table.withColumn("_s", sum((column(k) * float(x) for k, x in enumerate(w)), F.lit(0.0)))
        top = scored.groupBy(panel.date).agg(F.max("_s").alias("_top"))
        e = F.exp(F.col("_s") - F.col("_top"))
        days = scored.join(top, panel.date).groupBy(panel.date).agg(
            F.sum(e).alias("e"), F.first("_top").alias("top"), F.sum(F.col("_t") * F.col("_s")).alias("ts"),
            *(F.sum(e * column(k)).alias(f"a{k}") for k in range(f)), *(F.sum(F.col("_t") * column(k)).alias(f"t{k}") for k in range(f)),
            *(F.sum(e * column(i) * column(j)).alias(f"b{i}_{j}") for i, j in pairs),
        )
        mean = lambda k: F.col(f"a{k}") / F.col("e")
        found = days.agg(
            F.sum(F.log("e") + F.col("top") - F.col("ts")), *(F.sum(mean(k) - F.col(f"t{k}")) for k in range(f)),
            *(F.sum(F.col(f"b{i}_{j}") / F.col("e") - mean(i) * mean(j)) for i, j in pairs),
        ).first()
        curve = np.zeros((f, f))
        for (i, j), x in zip(pairs, found[1 + f :]):
            curve[i, j] = curve[j, i] = x
        return found[0] + penalty * float(w @ w) / 2, np.array(found[1 : 1 + f]) + penalty * w, curve + penalty * np.eye(f)

    w = np.zeros(f)
    loss, slope, curve = sums(w)
    rounds = 0
    try:
        while np.abs(step := np.linalg.solve(curve, slope)).max(initial=0.0) > tolerance:
            if rounds == most_rounds:
                raise ValueError(f"weights have not settled in {most_rounds} steps")
            new = sums(w - step)
            while new[0] > loss + 1e-9 * abs(loss):
                step = step / 2
                new = sums(w - step)
            w, (loss, slope, curve), rounds = w - step, new, rounds + 1
    finally:
        table.unpersist()
    return Ranker(tuple(features), tuple(w.tolist()), tuple(means), tuple(scales), as_of, about[2 * f], about[2 * f + 1], about[2 * f + 2], about[2 * f + 3], rounds)


def ndcg(df: DataFrame, label: str, rank: str = "rank", k: int | None = None, panel: Panel = PANEL) -> DataFrame:
    """date, ndcg: how near each date's ranking is to that of its grades, by discounted gains of 2^grade - 1 at the k
    first places, or all; NULL where all grades are 0."""
    full = df.filter(F.col(label).isNotNull()).withColumn("_gain", F.pow(F.lit(2.0), grades(label)) - 1)
    placed = full.withColumn("_place", R.first_rank(rank, [panel.date], [panel.entity])).withColumn("_ideal", R.first_rank("_gain", [panel.date], [panel.entity], descending=True))
    part = lambda place: F.sum(F.when(F.lit(True) if k is None else F.col(place) <= k, F.col("_gain") / F.log2(F.col(place) + 1.0)))
    return placed.groupBy(panel.date).agg(R.ratio(part("_place"), F.nullif(part("_ideal"), F.lit(0.0))).alias("ndcg"))
