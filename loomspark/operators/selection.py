"""Rankings with rules: total order, guard bands, buffers that remember, combined signals, changes of holdings."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomspark.functions import recipes as R
from loomspark.operators.panel import PANEL, Panel, calendar


def challenger_ranking(df: DataFrame, score: str, confirm: dict[str, float], top: int = 10, guard: int = 15, cutoff: float = 0.8, panel: Panel = PANEL) -> DataFrame:
    """Ranks by score, and a second ranking of the guard band by a composite.

    A row is in the band if it ranks up to ``guard`` and has ``cutoff`` of the score of the one that ranks ``top``. The
    composite is the weighted mean of the percent ranks of the ``confirm`` columns. A date with fewer rows than
    ``top``, or with an unknown score, is not ranked again, and says why.
    """
    d = R.by(panel.date)
    ranked = df.withColumn("base_rank", R.first_rank(score, [panel.date], [panel.entity], descending=True))
    line = F.max(F.when(F.col("base_rank") == top, F.col(score))).over(d)
    reason = F.when(F.count(F.lit(1)).over(d) < top, "too_few").when(F.count(score).over(d) < F.count(F.lit(1)).over(d), "unknown_score")
    ranked = ranked.withColumn("reason", reason).withColumn("in_band", F.coalesce((F.col("base_rank") <= guard) & (F.col(score) >= cutoff * line) & F.col("reason").isNull(), F.lit(False)))
    composite = R.mean_of([R.percent_rank(F.when(F.col("in_band"), F.col(c)), [panel.date]) for c in confirm], list(confirm.values()))
    ranked = ranked.withColumn("composite", F.when(F.col("in_band"), F.round(composite, 9)))
    again = F.row_number().over(Window.partitionBy(panel.date, "in_band").orderBy(F.col("composite").desc_nulls_last(), "base_rank"))
    return ranked.withColumn("challenger_rank", F.when(F.col("in_band"), again)).withColumn("selected", F.coalesce(F.col("challenger_rank") <= top, F.lit(False)))


def penalised_score(components: dict[str, float], penalties: Sequence[tuple[str, float, float, float]]):
    """Weighted components, unknown ones zero, less penalties: column, threshold, weight and most of the excess."""
    total = sum((F.coalesce(F.col(c), F.lit(0.0)) * w for c, w in components.items()), F.lit(0.0))
    for column, threshold, weight, most in penalties:
        total = total - weight * F.coalesce(R.clip(F.col(column) - threshold, 0.0, most), F.lit(0.0))
    return total


def holding_changes(positions: DataFrame, scored: DataFrame, score: str, panel: Panel = PANEL) -> DataFrame:
    """Entrants and exits between consecutive dates of positions, with the ranks before and after."""
    days = calendar(positions, panel)
    ranks = scored.withColumn("rank", R.first_rank(score, [panel.date], [panel.entity], descending=True)).select(*panel.keys, "rank")
    held = positions.select(*panel.keys).distinct().join(F.broadcast(days), panel.date)
    now = held.select(panel.entity, "position", F.lit(True).alias("now"))
    before = held.select(panel.entity, (F.col("position") + 1).alias("position"), F.lit(True).alias("before"))
    changed = now.join(before, [panel.entity, "position"], "full_outer").filter("now is null or before is null")
    dated = changed.join(F.broadcast(days), "position").join(F.broadcast(days.select((F.col("position") + 1).alias("position"), F.col(panel.date).alias("previous_date"))), "position")
    out = dated.withColumn("kind", F.when(F.col("now"), "entrant").otherwise("exit")).drop("now", "before", "position")
    out = out.join(ranks.withColumnRenamed("rank", "current_rank"), panel.keys, "left")
    return out.join(ranks.withColumnRenamed("rank", "previous_rank").withColumnRenamed(panel.date, "previous_date"), ["previous_date", panel.entity], "left")


def directions(ics: DataFrame, n: int, least: int, threshold: float, panel: Panel = PANEL) -> DataFrame:
    """The sign in force of each factor at each date: it turns only when the rolling mean, known the date before,
    passes the threshold on the other side. A state along a factor's dates, kept by an array's fold."""
    h = Window.partitionBy("factor").orderBy(panel.date)
    mean = F.lag(R.rolling(F.avg("rank_ic"), h.rowsBetween(1 - n, 0), "rank_ic", least)).over(h)
    signal = F.when(mean >= threshold, 1).when(mean <= -threshold, -1)
    marked = ics.withColumn("_s", signal)
    return marked.withColumn("direction", F.coalesce(F.last("_s", ignorenulls=True).over(h.rowsBetween(Window.unboundedPreceding, 0)), F.lit(1))).drop("_s")


def ensemble(df: DataFrame, signals: Sequence[str], strengths: DataFrame, out: str = "ensemble", panel: Panel = PANEL) -> DataFrame:
    """The mean of the date's z-scores, weighted by the strength that each signal has on the date (factor, date, strength)."""
    long = df.unpivot(panel.keys, list(signals), "factor", "value").filter("value is not null")
    z = long.withColumn("_z", R.zscore("value", [panel.date, "factor"], zero=0.0)).join(strengths.select(panel.date, "factor", "strength"), [panel.date, "factor"])
    sums = z.groupBy(*panel.keys).agg(R.ratio(F.sum(F.col("_z") * F.col("strength")), F.nullif(F.sum(F.abs("strength")), F.lit(0.0))).alias(out))
    return df.join(sums, panel.keys, "left")


def capped_weights(weights: np.ndarray, most: float) -> np.ndarray:
    """Shares of the weights' sum with none above ``most``: what the largest lose goes to the others in proportion.

    The fewest largest are cut for which the others, scaled up, stay below; weights of zero share alike what is left
    for them alone. A cap that cannot hold for so few gives equal weights, and one outside of 0 to 1 is none. Missing
    or negative weights are zero; without a positive one all are missing.
    """
    w = np.clip(np.nan_to_num(np.asarray(weights, float)), 0, None)
    if w.sum() <= 0:
        return np.full(len(w), np.nan)
    if not 0 < most < 1:
        return w / w.sum()
    order = np.argsort(-w, kind="stable")
    for cut in range(len(w)):
        rest, left = w[order[cut:]], 1 - cut * most
        scaled = left * rest / rest.sum() if rest.sum() > 0 else np.full(len(rest), left / len(rest))
        if scaled.max() <= most + 1e-12:
            out = np.full(len(w), most)
            out[order[cut:]] = scaled
            return out
    return np.full(len(w), 1 / len(w))


def softmax_weights(df: DataFrame, score: str, k: int, most: float, temperature: float = 1.0, out: str = "weight", panel: Panel = PANEL) -> DataFrame:
    """The k best rows of each date, weighted by the exponential of their z-scores and capped."""

    def weigh(day: pd.DataFrame) -> pd.DataFrame:
        x = day[score].to_numpy(float)
        z = (x - x.mean()) / x.std() if x.std() > 0 else x * 0
        return day.assign(**{out: capped_weights(np.exp(z / temperature), most)})

    best = df.filter(F.col(score).isNotNull()).withColumn("_r", R.first_rank(score, [panel.date], [panel.entity], descending=True)).filter(F.col("_r") <= k).select(*panel.keys, score)
    return best.groupBy(panel.date).applyInPandas(weigh, best.withColumn(out, F.lit(0.0)).schema)


def exploded_rankings(df: DataFrame, lists: Sequence[str], keys: Sequence[str], out: str) -> DataFrame:
    """A row for each place of the first of the ranked lists that is not null or empty."""
    chosen = F.coalesce(*(F.when(F.size(c) > 0, F.col(c)) for c in lists))
    return df.select(*keys, F.posexplode(chosen).alias("place", out)).withColumn("place", F.col("place") + 1)


def classified(df: DataFrame, text: str, rules: DataFrame, out: str) -> DataFrame:
    """The class of each row by the first rule that applies: rules of (priority, pattern, label), by equality or as a part.

    Rules are a dictionary of a few hundred entries; texts are matched once each.
    """
    names = df.select(text).distinct()
    hits = names.join(F.broadcast(rules), (F.col(text) == F.col("pattern")) | F.contains(F.col(text), F.col("pattern")))
    first = hits.groupBy(text).agg(F.min_by("label", F.struct((F.col(text) != F.col("pattern")).alias("part"), "priority")).alias(out))
    return df.join(first, text, "left")
