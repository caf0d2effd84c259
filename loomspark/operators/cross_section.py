"""Transforms within a date: ranks, winsorising, standardising, neutralising, blending, scores."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.functions import recipes as R
from loomspark.operators.panel import PANEL, Panel


def transform(df: DataFrame, features: Sequence[str], method: str, winsorize: float | None = None, groups: Sequence[str] = (), panel: Panel = PANEL) -> DataFrame:
    """Features by date and group: none, zscore, robust, rank (centred percent rank) or rank_relevance."""
    keys = [panel.date, *groups]
    if winsorize:
        df = df.withColumns({f: R.quantile_clip(f, keys, winsorize, 1 - winsorize) for f in features})
    if method == "none":
        return df
    if method == "zscore":
        return df.withColumns({f: R.zscore(f, keys, zero=0.0) for f in features})
    if method == "robust":
        middle = df.withColumns({f"_m_{f}": F.median(f).over(R.by(*keys)) for f in features})
        spread = middle.withColumns({f"_d_{f}": F.median(F.abs(F.col(f) - F.col(f"_m_{f}"))).over(R.by(*keys)) for f in features})
        out = {f: F.coalesce(R.ratio(F.col(f) - F.col(f"_m_{f}"), F.nullif(F.col(f"_d_{f}"), F.lit(0.0))), F.lit(0.0)) for f in features}
        return spread.withColumns(out).drop(*(f"_{k}_{f}" for f in features for k in "md"))
    if method == "rank":
        return df.withColumns({f: R.percent_rank(f, keys) - 0.5 for f in features})
    if method == "rank_relevance":
        return df.withColumns({f: F.when(F.col(f).isNotNull(), F.dense_rank().over(R.by(*keys).orderBy(F.col(f).asc_nulls_last())) - 1) for f in features})
    raise ValueError(f"unknown method {method!r}")


def neutralize(df: DataFrame, score: str, controls: Sequence[str], strength: float = 1.0, least: int | None = None, out: str | None = None, panel: Panel = PANEL) -> DataFrame:
    """The score less ``strength`` times what the controls explain of it on each date, the mean kept.

    Dates with fewer complete rows than ``least``, and rows that are not complete, keep their score. One control
    needs window sums alone; several are solved date by date.
    """
    out, least = out or score, least or len(controls) + 2
    if len(controls) == 1:
        x, y, w = F.col(controls[0]), F.col(score), R.by(panel.date)
        both = x.isNotNull() & y.isNotNull()
        a, b = F.when(both, x), F.when(both, y)
        fitted = F.regr_slope(b, a).over(w) * (x - F.avg(a).over(w))
        return df.withColumn(out, F.when(both & (F.count(a).over(w) >= least), y - strength * F.coalesce(fitted, F.lit(0.0))).otherwise(y))

    def solve(group: pd.DataFrame) -> pd.DataFrame:
        group = group.copy()
        value = group[score].astype(float)
        full = group[[score, *controls]].notna().all(axis=1).to_numpy()
        result = value.to_numpy(copy=True)
        if full.sum() >= least:
            x = group.loc[full, list(controls)].to_numpy(float)
            x = x - x.mean(0)
            beta = np.linalg.lstsq(np.column_stack([np.ones(len(x)), x]), value[full].to_numpy(), rcond=None)[0]
            result[full] -= strength * (x @ beta[1:])
        group[out] = result
        return group

    schema = df.withColumn(out, F.col(score).cast("double")).schema
    return df.groupBy(panel.date).applyInPandas(solve, schema)


def rank_blend(df: DataFrame, score: str, overlays: Sequence[str], strength: float, out: str, panel: Panel = PANEL) -> DataFrame:
    """(1 - strength) of the score's percent rank and strength of the overlays' mean, of the score alone where none is known."""
    base = R.percent_rank(score, [panel.date])
    mean = R.mean_of([R.percent_rank(o, [panel.date]) for o in overlays])
    return df.withColumn(out, F.coalesce((1 - strength) * base + strength * mean, base))


def standardize(df: DataFrame, factors: Sequence[str], industry: str, low: float = 0.01, high: float = 0.99, panel: Panel = PANEL) -> DataFrame:
    """Winsorised by date, demeaned by date and industry (no industry is one of its own), z-scored by date."""
    d = [panel.date]
    df = df.withColumns({f: R.quantile_clip(f, d, low, high) for f in factors})
    df = df.withColumns({f: F.col(f) - F.avg(f).over(R.by(panel.date, industry)) for f in factors})
    return df.withColumns({f: R.zscore(f, d, sample=True) for f in factors})


def freshness_overlay(df: DataFrame, score: str, volume_ratios: Sequence[str], weight: float, panel: Panel = PANEL) -> DataFrame:
    """The score's rank blended with the mean rank of volume ratios, unknown ones last; the score's rank is kept."""
    d = [panel.date]
    base = R.percent_rank_bottom(score, d)
    fresh = R.mean_of([R.percent_rank_bottom(v, d) for v in volume_ratios])
    return df.withColumn(f"{score}_base", base).withColumn(f"{score}_fresh", (1 - weight) * base + weight * fresh)


def weighted_rank_score(df: DataFrame, specs: Sequence[tuple[str, float, bool]], out: str = "score", group: Sequence[str] = (), panel: Panel = PANEL) -> DataFrame:
    """The weighted mean of the percent ranks that are known, with their share of the weights, rank and percentile.

    specs: column, weight, whether more is better.
    """
    keys = [panel.date, *group]
    ranks = [R.percent_rank(c if up else -F.col(c), keys) for c, _, up in specs]
    names = [f"_r{k}" for k in range(len(ranks))]
    df = df.withColumns(dict(zip(names, ranks)))
    weights = [w for _, w, _ in specs]
    known = sum((F.when(F.col(n).isNotNull(), F.lit(float(w))).otherwise(0.0) for n, w in zip(names, weights)), F.lit(0.0))
    df = df.withColumn(out, R.mean_of([F.col(n) for n in names], weights)).withColumn(f"{out}_coverage", known / sum(weights)).drop(*names)
    rank = F.when(F.col(out).isNotNull(), F.rank().over(R.by(panel.date).orderBy(F.col(out).desc_nulls_last())))
    return df.withColumn(f"{out}_rank", rank).withColumn(f"{out}_percentile", R.percent_rank(out, [panel.date]))


def candidates(df: DataFrame, score: str, coverage: str, least_coverage: float, top: float, panel: Panel = PANEL) -> DataFrame:
    """is_candidate: at or above the date's quantile of the rows with enough coverage."""
    eligible = F.col(coverage) >= least_coverage
    cut = F.percentile(F.when(eligible, F.col(score)), 1 - top).over(R.by(panel.date))
    return df.withColumn("is_candidate", F.coalesce(eligible & (F.col(score) >= cut), F.lit(False)))


def buffered(df: DataFrame, score: str, holdings: DataFrame, top: float, buffer: float, panel: Panel = PANEL) -> DataFrame:
    """enters: in the top share by rank; stays: held already and in the wider share."""
    n = F.count(score).over(R.by(panel.date))
    share = R.first_rank(score, [panel.date], [panel.entity], descending=True) / n
    held = holdings.select(panel.entity).distinct().withColumn("held", F.lit(True))
    return df.join(held, panel.entity, "left").withColumn("rank_share", F.when(F.col(score).isNotNull(), share)).withColumn("enters", F.coalesce(F.col("rank_share") <= top, F.lit(False))).withColumn("stays", F.coalesce(F.col("held") & (F.col("rank_share") <= buffer), F.lit(False))).drop("held")


def fused(df: DataFrame, weights: dict[str, float], out: str = "fused_score") -> DataFrame:
    """The weighted mean of the scores that are known, and their share of the weights."""
    columns = [F.col(c) for c in weights]
    known = sum((F.when(c.isNotNull(), F.lit(float(w))).otherwise(0.0) for c, w in zip(columns, weights.values())), F.lit(0.0))
    return df.withColumn(out, R.mean_of(columns, list(weights.values()))).withColumn(f"{out}_coverage", known / sum(weights.values()))


def exposures(df: DataFrame, industry: str, priors: dict[str, float], modifiers: Sequence[tuple[str, float, float, str]], low: float, high: float, unknown: float = 0.0, out: str = "exposure", panel: Panel = PANEL) -> DataFrame:
    """An industry's prior plus directed, weighted, normalised fundamentals, held between two bounds, with its parts.

    modifiers: field, direction, weight, rank_pct (-1 to 1) or zscore (within three deviations, over three); an
    unknown field adds nothing. The parts are kept as an array of structs.
    """
    n = lambda f: F.count(f).over(R.by(panel.date))
    prior = F.lit(unknown)
    for name, value in priors.items():
        prior = F.when(F.col(industry).cast("string") == name, value).otherwise(prior)
    parts: list[tuple[str, Column]] = []
    for field, direction, weight, kind in modifiers:
        if kind == "rank_pct":
            score = F.when(F.col(field).isNotNull(), F.when(n(field) == 1, 0.0).otherwise(R.ratio(2 * (R.average_rank(field, [panel.date]) - 1), n(field) - 1) - 1))
        else:
            score = R.clip(R.zscore(field, [panel.date], zero=None), -3.0, 3.0) / 3
        parts.append((field, direction * weight * score))
    df = df.withColumn("_prior", prior).withColumns({f"_p{k}": p for k, (_, p) in enumerate(parts)})
    total = F.col("_prior") + sum((F.coalesce(f"_p{k}", F.lit(0.0)) for k in range(len(parts))), F.lit(0.0))
    evidence = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"_p{k}").alias("part")) for k, (f, _) in enumerate(parts)))
    return df.withColumn(out, R.clip(total, low, high)).withColumn(f"{out}_evidence", F.struct(F.col("_prior").alias("prior"), evidence.alias("modifiers"))).drop("_prior", *(f"_p{k}" for k in range(len(parts))))


def mean_zscore(df: DataFrame, columns: Sequence[str], out: str, panel: Panel = PANEL) -> DataFrame:
    return df.withColumn(out, R.mean_of([F.when(F.col(c).isNotNull(), R.zscore(c, [panel.date], zero=0.0)) for c in columns]))


def top_k(df: DataFrame, score: str, k: int, panel: Panel = PANEL) -> DataFrame:
    """The k best rows of each date, ties by entity."""
    return df.filter(F.col(score).isNotNull()).withColumn("rank", R.first_rank(score, [panel.date], [panel.entity], descending=True)).filter(F.col("rank") <= k)
