"""Composed features: value ranks, composite scores, transforms of context series, modelling frames, recent slices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomspark.functions import recipes as R
from loomspark.operators import cross_section as cs
from loomspark.operators.panel import PANEL, Panel, on_dates, period_ends


def value_features(df: DataFrame, ratios: Sequence[str], panel: Panel = PANEL) -> DataFrame:
    """The percent rank of each positive ratio's inverse, whether it was observed, and the date's coverage."""
    df = df.withColumns({f"inverse_{c}": F.when(F.col(c) > 0, R.ratio(F.lit(1.0), c)) for c in ratios})
    out = {f"{c}_rank": R.percent_rank(f"inverse_{c}", [panel.date]) for c in ratios}
    out |= {f"{c}_observed": F.col(f"inverse_{c}").isNotNull() for c in ratios}
    out |= {f"{c}_coverage": F.avg(F.col(f"inverse_{c}").isNotNull().cast("double")).over(R.by(panel.date)) for c in ratios}
    return df.withColumns(out)


def composite_score(df: DataFrame, weights: dict[str, float], tie: str | None = None, out: str = "score", panel: Panel = PANEL) -> DataFrame:
    """The weighted sum of percent ranks, unknown values last, a hundredth of the tie-break's rank added; from 0 to 1.

    A negative weight ranks from the other end. The largest part names the reason.
    """
    total = sum(abs(w) for w in weights.values())
    ranks = {c: R.percent_rank_bottom(c, [panel.date]) for c in weights}
    parts = {f"_{c}": (r if weights[c] > 0 else 1 - r) * (abs(weights[c]) / total) for c, r in ranks.items()}
    df = df.withColumns(parts)
    score = sum((F.col(p) for p in parts), F.lit(0.0))
    if tie:
        score = (score + 0.01 * R.percent_rank_bottom(tie, [panel.date])) / 1.01
    best = F.greatest(*parts)
    reason = F.coalesce(*(F.when(F.col(p) >= best - 1e-9, p[1:]) for p in parts))
    return df.withColumn(out, R.clip(score, 0.0, 1.0)).withColumn(f"{out}_reason", reason).drop(*parts)


def context_features(series: DataFrame, n: int, least: int, key: str = "series_id", date: str = "period_end", value: str = "value") -> DataFrame:
    """Of each series: differences of one and n, the second difference, the difference to the same day of the year
    before, a rolling z-score and the share of the last n values at or below the present one, after ``least`` values."""
    h = Window.partitionBy(key).orderBy(date)
    w = h.rowsBetween(1 - n, 0)
    before = series.select(key, F.add_months(date, 12).alias(date), F.col(value).alias("_old"))
    df = series.join(before, [key, date], "left").withColumn("_n", F.count(value).over(h.rowsBetween(Window.unboundedPreceding, 0)))
    first = F.col(value) - F.lag(value).over(h)
    df = df.withColumn("diff_1", first).withColumn(f"diff_{n}", F.col(value) - F.lag(value, n).over(h)).withColumn("second_diff", F.col("diff_1") - F.lag("diff_1").over(h)).withColumn("yoy", F.col(value) - F.col("_old"))
    spread = F.stddev_pop(value).over(w)
    df = df.withColumn("zscore", F.when((F.count(value).over(w) >= n) & (spread > 0), (F.col(value) - F.avg(value).over(w)) / spread))
    seen = F.collect_list(value).over(w)
    df = df.withColumn("_seen", seen)
    share = F.size(F.filter("_seen", lambda x: x <= F.col(value))) / F.size("_seen")
    df = df.withColumn("percentile", F.when((F.size("_seen") >= n) & F.col(value).isNotNull(), share))
    made = ["diff_1", f"diff_{n}", "second_diff", "yoy", "zscore", "percentile"]
    return df.withColumns({c: F.when(F.col("_n") >= least, F.col(c)) for c in made}).drop("_old", "_n", "_seen")


def retention_label(df: DataFrame, now: Sequence[str], later: Sequence[str], shares: Sequence[float], out: str = "retained") -> DataFrame:
    """Whether each later value keeps its share of the present one: yes, no, or NULL where one is unknown and none fails."""
    tests = [F.col(b) >= F.col(a) * s for a, b, s in zip(now, later, shares)]
    return df.withColumn(out, F.forall(F.array(*tests), lambda x: x))


def modelling_frame(df: DataFrame, features: Sequence[str], target: str, frequency: str, method: str, winsorize: float, least: int, panel: Panel = PANEL) -> DataFrame:
    """The panel's complete rows on the last date of each period, target winsorised, features transformed, of dates that
    keep ``least`` entities. Histories must have been worked out before: no row is looked back for here."""
    full = on_dates(df, period_ends(df, frequency, panel), panel).dropna(subset=[*features, target])
    full = full.withColumn(target, R.quantile_clip(target, [panel.date], winsorize, 1 - winsorize))
    full = cs.transform(full, features, method, panel=panel).withColumn("_n", F.count(F.lit(1)).over(R.by(panel.date)))
    return full.filter(F.col("_n") >= least).drop("_n")


def recent_slices(series: DataFrame, value: str, date: str, months: Sequence[int], per_year: float) -> DataFrame:
    """months, n, mean, total and Sharpe ratio of the last months of one series, each slice a row."""
    last = series.agg(F.max(date).alias("_last"))
    spans = F.explode(F.array(*(F.lit(m) for m in months))).alias("months")
    placed = series.join(F.broadcast(last), how="left").select(date, value, "_last", spans)  # one row
    within = placed.filter(F.col(date) > F.add_months("_last", -F.col("months")))
    sharpe = R.ratio(F.avg(value), F.nullif(F.stddev_samp(value), F.lit(0.0))) * F.sqrt(F.lit(per_year))
    return within.groupBy("months").agg(F.count(value).alias("n"), F.avg(value).alias("mean"), R.compounded(value).alias("total"), sharpe.alias("sharpe"))


def shifted_target(df: DataFrame, target: str, n: int, out: str = "shifted_target", panel: Panel = PANEL) -> DataFrame:
    """A negative control: the entity's target of n rows later."""
    return df.withColumn(out, F.lead(target, n).over(panel.history()))
