"""Choice of factors, scores by regime, and weights that remember: what an ensemble of signals decides at each date."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import combinations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspark.functions import recipes as R
from loomspark.operators.panel import PANEL, Panel, calendar
from loomspark.sources.checkpoints import kept


def rolling_correlations(df: DataFrame, factors: Sequence[str], window: int, panel: Panel = PANEL) -> DataFrame:
    """date, left_factor, right_factor, corr, n_obs: the correlation of each pair of factors over all rows of the
    ``window`` dates before each date, where both are known.

    The panel is read once for the sums of each date and pair; a window's correlation comes from sums of sums.
    """
    pairs = list(combinations(sorted(factors), 2))
    parts = []
    for k, (a, b) in enumerate(pairs):
        x, y = F.col(a).cast("double"), F.col(b).cast("double")
        both = x.isNotNull() & y.isNotNull()
        values = {"n": F.lit(1.0), "x": x, "y": y, "xx": x * x, "yy": y * y, "xy": x * y}
        parts += [F.coalesce(F.sum(F.when(both, v)), F.lit(0.0)).alias(f"_{k}_{name}") for name, v in values.items()]
    names = ("n", "x", "y", "xx", "yy", "xy")
    each = F.array(*(F.struct(F.lit(a).alias("left_factor"), F.lit(b).alias("right_factor"), *(F.col(f"_{k}_{s}").alias(s) for s in names)) for k, (a, b) in enumerate(pairs)))
    days = df.groupBy(panel.date).agg(*parts).select(panel.date, F.explode(each).alias("s")).select(panel.date, "s.*")
    before = Window.partitionBy("left_factor", "right_factor").orderBy(panel.date).rowsBetween(-window, -1)  # a row a date
    summed = days.select(panel.date, "left_factor", "right_factor", *(F.coalesce(F.sum(s).over(before), F.lit(0.0)).alias(s) for s in names))
    spread = lambda one, two: F.col("n") * F.col(two) - F.col(one) * F.col(one)
    scale = F.when((spread("x", "xx") > 1e-12) & (spread("y", "yy") > 1e-12), F.sqrt(spread("x", "xx") * spread("y", "yy")))
    return summed.select(panel.date, "left_factor", "right_factor", ((F.col("n") * F.col("xy") - F.col("x") * F.col("y")) / scale).alias("corr"), F.col("n").cast("long").alias("n_obs"))


def select_factors(
    diagnostics: DataFrame,
    correlations: DataFrame,
    checks: Sequence[tuple[str, str, float | None]],
    threshold: float,
    least_strength: float | None = None,
    fallback: int = 1,
    panel: Panel = PANEL,
) -> DataFrame:
    """date, factor, selected, reason: of each date's factors, in order of strength, those that are not too correlated
    with one chosen before.

    diagnostics: date, factor, strength, and the columns of ``checks``: (column, reason, least value or None for no
    check). The first check that fails gives the reason, an unknown value ``insufficient_history``; a strength below
    ``least_strength`` is ``strength_below_threshold``. Where none passes, the ``fallback`` strongest are candidates. A
    candidate whose correlation with a chosen one is above ``threshold`` on either side is ``correlation_filtered``;
    unknown correlations are 0. Unknown strengths come last, ties go by name, and chosen ones have the reason ''.
    """
    day = [panel.date]
    reason = F.lit(None).cast("string")
    for column, name, least in reversed([c for c in checks if c[2] is not None]):
        reason = F.when(F.col(column).isNull(), "insufficient_history").when(F.col(column) < least, name).otherwise(reason)
    weak = F.when(F.col("strength") < least_strength, "strength_below_threshold") if least_strength is not None else F.lit(None).cast("string")
    own = diagnostics.select(panel.date, "factor", "strength", F.coalesce(reason, weak).alias("_reason"))
    order = Window.partitionBy(*day).orderBy(F.col("strength").desc_nulls_last(), "factor")
    own = own.withColumn("_place", F.row_number().over(order)).withColumn("_none", F.count(F.when(F.col("_reason").isNull(), 1)).over(R.by(*day)) == 0)
    candidate = F.col("_reason").isNull() | (F.col("_none") & F.col("strength").isNotNull() & (F.col("_place") <= fallback))
    own = own.withColumn("_candidate", candidate)
    listed = own.groupBy(*day).agg(F.transform(F.sort_array(F.collect_list(F.when(F.col("_candidate"), F.struct("_place", "factor")))), lambda x: x["factor"]).alias("_names"))
    both = F.explode(F.array(F.struct(F.col("left_factor").alias("a"), F.col("right_factor").alias("b")), F.struct(F.col("right_factor").alias("a"), F.col("left_factor").alias("b"))))
    high = correlations.filter(F.abs("corr") > threshold).select(panel.date, both.alias("p")).groupBy(*day).agg(F.collect_set(F.struct("p.a", "p.b")).alias("_high"))
    chosen = F.aggregate(
        "_names",
        F.array().cast("array<string>"),
        lambda done, x: F.when(F.exists(done, lambda y: F.array_contains(F.col("_high"), F.struct(x.alias("a"), y.alias("b")))), done).otherwise(F.array_append(done, x)),
    )
    listed = listed.join(high, day, "left").withColumn("_high", F.coalesce("_high", F.array().cast("array<struct<a:string,b:string>>")))
    out = own.join(listed.select(*day, chosen.alias("_chosen")), day)
    selected = F.array_contains("_chosen", F.col("factor"))
    why = F.when(selected, "").when(F.col("_candidate"), "correlation_filtered").otherwise(F.coalesce("_reason", F.lit("")))
    return out.select(panel.date, "factor", selected.alias("selected"), why.alias("reason"))


def regime_scores(returns: DataFrame, features: DataFrame, window: int, panel: Panel = PANEL) -> DataFrame:
    """date, factor, regime_score: how each factor did on those of the ``window`` dates before on which the market was as
    it is now, as a standard score across factors.

    returns: date, factor, value. features: date, feature, value, such as volatility. Of each feature's known values in
    the window, a third each are low and high, by linear quantiles; the factor's mean return over the dates of today's
    third, averaged over features. Features with fewer than a third of the window, 3 at least, do not count; dates
    without any, or with fewer than ``window`` dates before them, score 0, as do unknown scores.
    """
    days = calendar(returns, panel)
    names = features.select("feature").distinct()
    grid = days.join(names.agg(F.collect_list("feature").alias("_all")), how="left")  # one row of names
    grid = grid.select(panel.date, "position", F.explode("_all").alias("feature")).join(features.select(panel.date, "feature", R.clean("value").alias("value")), [panel.date, "feature"], "left")
    before = Window.partitionBy("feature").orderBy("position").rowsBetween(-window, -1)  # a row a date
    seen = F.collect_list(F.when(F.col("value").isNotNull(), F.struct("value", "position"))).over(before)
    known = grid.withColumn("_seen", F.sort_array(seen)).filter((F.col("position") > window) & F.col("value").isNotNull() & (F.size("_seen") >= max(3, window // 3)))

    def quantile(q: float) -> Column:
        at = (F.size("_seen") - 1) * F.lit(q)
        low = F.floor(at).cast("int")
        value = lambda k: F.element_at("_seen", k + 1)["value"]
        return value(low) + (at - low) * (value(F.least(low + 1, F.size("_seen") - 1)) - value(low))

    known = known.withColumn("_low", quantile(1 / 3)).withColumn("_high", quantile(2 / 3))
    like = (
        F.when(F.col("value") <= F.col("_low"), F.filter("_seen", lambda x: x["value"] <= F.col("_low")))
        .when(F.col("value") >= F.col("_high"), F.filter("_seen", lambda x: x["value"] >= F.col("_high")))
        .otherwise(F.filter("_seen", lambda x: (x["value"] > F.col("_low")) & (x["value"] < F.col("_high"))))
    )
    alike = known.select(panel.date, "feature", F.explode(like).alias("x")).select(panel.date, "feature", F.col("x.position").alias("position"))
    past = returns.join(days, panel.date).select("position", "factor", R.clean("value").alias("_r"))
    means = alike.join(past, "position").groupBy(panel.date, "feature", "factor").agg(F.avg("_r").alias("_m"))
    means = means.groupBy(panel.date, "factor").agg(F.avg("_m").alias("_score"))
    scored = returns.select(panel.date, "factor").distinct().join(means, [panel.date, "factor"], "left")
    # a date with a score for any factor leaves those without one unknown; one without any has zeros
    some = F.count("_score").over(R.by(panel.date)) > 0
    scored = scored.withColumn("_score", F.when(some, F.col("_score")).otherwise(F.lit(0.0)))
    return scored.select(panel.date, "factor", R.zscore("_score", [panel.date], zero=0.0).alias("regime_score"))


Fold = Callable[[dict, list[tuple]], tuple[dict, list[tuple]]]


def carried(rows: DataFrame, columns: Sequence[str], fold: Fold, out: Sequence[tuple[str, str]], group: Sequence[str] = (), block: int = 512, panel: Panel = PANEL) -> DataFrame:
    """What a fold over dates gives, group by group, with a state of entity and number that goes from date to date.

    fold(state, day) takes the state before a date, {entity: number}, and the date's rows, (entity, *columns), by entity;
    it returns the state after it and rows (entity, *out). Dates go in blocks of ``block``: a task holds the rows of one
    group's block and its state, which is kept in the checkpoint folder between blocks. No date sees later ones.
    """
    day, entity = panel.date, panel.entity
    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    placed = rows.select(*group, day, entity, *columns).join(calendar(rows, panel), day).withColumn("_block", F.expr(f"cast((position - 1) div {block} as int)")).drop("position")
    placed = kept(placed)
    last = placed.agg(F.max("_block")).first()[0]
    schema = ", ".join([*(f"{g} {types[g]}" for g in group), f"{day} {types[day]}", f"{entity} {types[entity]}", "_state double", *(f"{c} {t}" for c, t in out)])
    names = [*group, day, entity, "_state", *(c for c, _ in out)]

    def over_block(part: pd.DataFrame) -> pd.DataFrame:
        key = [part[g].iloc[0] for g in group]
        before = part[part[day].isna()]
        state = dict(zip(before[entity], before["_state"]))
        found = []
        for date, rows in part[part[day].notna()].sort_values([day, entity]).groupby(day, sort=True):
            state, made = fold(state, list(rows[[entity, *columns]].itertuples(index=False, name=None)))
            found += [(*key, date, e, None, *values) for e, *values in made]
        found += [(*key, None, e, w, *(None for _ in out)) for e, w in state.items()]
        return pd.DataFrame(found, columns=names).astype({day: object, "_state": float})

    state, results = None, None
    for k in range((last if last is not None else -1) + 1):
        part = placed.filter(F.col("_block") == k).drop("_block").withColumn("_state", F.lit(None).cast("double"))
        part = part if state is None else part.unionByName(state, allowMissingColumns=True)
        done = kept(part.withColumn("_one", F.lit(0)).groupBy("_one", *group).applyInPandas(over_block, schema))
        state = done.filter(F.col(day).isNull()).select(*group, day, entity, "_state")
        made = done.filter(F.col(day).isNotNull()).drop("_state")
        results = made if results is None else results.unionByName(made)
    return results if results is not None else rows.sparkSession.createDataFrame([], schema).drop("_state")


def turnover_budget(targets: DataFrame, weight: str, most: float, group: Sequence[str] = (), least: float = 1e-12, block: int = 512, panel: Panel = PANEL) -> DataFrame:
    """date, entity, weight, turnover: target weights of each date, moved to from those held no further than a budget.

    turnover is the sum of the changes that the targets ask for. Where it is over ``most``, each weight goes the same
    part of its way, so that ``most`` is used up, negative ones are 0, and their sum is 1 again. The first date, and
    dates before which nothing is held, take their targets, as all do from a budget of 2 on. Weights below ``least`` are
    let go. A date without targets changes nothing and has no rows.
    """

    def move(held: dict, day: list[tuple]) -> tuple[dict, list[tuple]]:
        target = {e: w for e, w in day if w is not None}
        moved = {e: target.get(e, 0.0) - held.get(e, 0.0) for e in sorted({*held, *target})}
        turnover = sum(map(abs, moved.values()))
        new = target
        if sum(held.values()) > 0 and most < 2.0 and turnover > max(most, 1e-12):
            part = {e: max(0.0, held.get(e, 0.0) + x * (most / turnover)) for e, x in moved.items()}
            if (total := sum(part.values())) > 0:
                new = {e: w / total for e, w in part.items()}
        new = {e: w for e, w in new.items() if w >= least}
        return new, [(e, w, turnover) for e, w in new.items()]

    rows = targets.withColumn(weight, R.clean(weight))
    return carried(rows, [weight], move, [("weight", "double"), ("turnover", "double")], group, block, panel)


def held_with_buffer(df: DataFrame, score: str, k: int, buffer: int, group: Sequence[str] = (), block: int = 512, panel: Panel = PANEL) -> DataFrame:
    """date, entity, rank, kept: the k holdings of each date, where those held the date before stay while they rank
    within the buffer. Only the rows within the buffer take part, ``buffer`` a date."""
    ranked = df.filter(F.col(score).isNotNull()).withColumn("rank", R.first_rank(score, [panel.date, *group], [panel.entity], descending=True)).filter(F.col("rank") <= buffer)

    def hold(held: dict, day: list[tuple]) -> tuple[dict, list[tuple]]:
        day = sorted(day, key=lambda x: x[1])
        stay = [x for x in day if x[0] in held][:k]
        new = [x for x in day if x[0] not in held][: k - len(stay)]
        return {e: 1.0 for e, _ in [*stay, *new]}, [(e, r, e in held) for e, r in sorted([*stay, *new], key=lambda x: x[1])]

    return carried(ranked, ["rank"], hold, [("rank", "int"), ("kept", "boolean")], group, block, panel)
