"""Combinatorial purged cross-validation: every choice of test groups of dates, models from sums, and paths.

Dates are cut into consecutive groups, and each choice of some of them is a split that tests on these and trains on
the other dates, without those whose labels reach into a test date's label or that follow one too soon. The panel is
read once for the sums of squares and products of each date: a split's normal equations are the sum over its train
dates, so that no split reads or fits the panel again. Splits without a common group are put together into paths,
which have one out-of-sample result for each date.

Tables of a row a date, a split or a path are small, whatever the panel; everything else is grouped by date.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomspark.functions import recipes as R
from loomspark.operators import diagnostics as dg
from loomspark.operators.panel import PANEL, Panel

#: Splits at most: they are a list of the driver's, and each date has a row for each.
MOST_SPLITS = 10_000


@dataclass(frozen=True)
class Plan:
    """n groups of dates, k of them tested at a time. embargo_days: days after a label's end without training; gap:
    positions around all tested dates without training, where labels' windows are unknown."""

    n: int
    k: int
    embargo_days: int = 0
    gap: int = 0
    least_train: int = 1
    least_test: int = 1

    def __post_init__(self) -> None:
        if not 1 <= self.k < self.n:
            raise ValueError("k must be from 1 to n - 1")
        if self.n > 62 or comb(self.n, self.k) > MOST_SPLITS:
            raise ValueError(f"{self.k} of {self.n} groups are more than {MOST_SPLITS} splits")

    def chosen(self) -> list[tuple[int, ...]]:
        """The test groups of each split; the first one's number is 1."""
        return list(combinations(range(self.n), self.k))

    def masks(self) -> list[int]:
        return [sum(1 << g for g in groups) for groups in self.chosen()]

    def paths(self, splits: Sequence[int]) -> list[tuple[int, int]]:
        """(path, split): in order, each of the given splits goes to the first path that tests none of its groups; one
        that finds none is in no path."""
        masks, covered, out = self.masks(), [0] * comb(self.n - 1, self.k - 1), []
        for split in sorted(splits):
            free = next((p for p, c in enumerate(covered) if not c & masks[split - 1]), None)
            if free is not None:
                covered[free] |= masks[split - 1]
                out.append((free + 1, split))
        return out


def roles(dates: DataFrame, plan: Plan, panel: Panel = PANEL) -> DataFrame:
    """split_id, date, role (test, train, purged, embargoed), purge_mode: each date in each split.

    dates: a row a date, with the label's window as label_start and label_end. A train date is purged where its window
    meets that of any tested date, or is unknown, and otherwise embargoed where it follows the end of one within the
    embargo. If a tested date's window is unknown, dates within the gap of all tested dates are purged instead.
    """
    day = panel.date
    order = Window.orderBy(day)  # one row a date
    own = dates.select(day, F.col("label_start").alias("_a"), F.col("label_end").alias("_b")).dropDuplicates([day])
    own = own.withColumn("_a", F.when(F.col("_b").isNotNull(), F.col("_a"))).withColumn("_b", F.when(F.col("_a").isNotNull(), F.col("_b")))
    own = own.withColumn("_g", F.ntile(plan.n).over(order) - 1).withColumn("_pos", F.row_number().over(order))
    known = own.filter("_a is not null")

    # each date against each other group: the latest end among the windows of the group that begin by its end
    queries = known.withColumn("_of", F.explode(F.sequence(F.lit(0), F.lit(plan.n - 1)))).filter("_of <> _g")
    events = known.select(F.col("_g").alias("_of"), F.col("_a").alias("_point"), F.lit(0).alias("_kind"), F.col("_b").alias("_end"))
    both = events.unionByName(queries.select("_of", F.col("_b").alias("_point"), F.lit(1).alias("_kind"), day, "_a"), allowMissingColumns=True)
    past = Window.partitionBy("_of").orderBy("_point", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_of"))
    meets = both.withColumn("_last", F.max("_end").over(past)).filter("_kind = 1 and _last >= _a").groupBy(day).agg(F.bit_or(bit).alias("_purge"))
    # and the latest end before the date itself
    events = known.select(F.col("_g").alias("_of"), F.col("_b").alias("_point"), F.lit(1).alias("_kind"), F.col("_b").alias("_end"))
    both = events.unionByName(queries.select("_of", F.col(day).alias("_point"), F.lit(0).alias("_kind"), day), allowMissingColumns=True)
    late = (F.col("_kind") == 0) & (F.date_add("_last", plan.embargo_days) >= F.col(day))
    follows = both.withColumn("_last", F.max("_end").over(past)).filter(late).groupBy(day).agg(F.bit_or(bit).alias("_embargo"))

    groups = {r["_g"]: r for r in own.groupBy("_g").agg(F.min("_pos").alias("low"), F.max("_pos").alias("high"), F.count(F.lit(1)).alias("n"), F.count("_a").alias("known")).collect()}  # a row a group
    if len(groups) < plan.n:
        raise ValueError(f"{plan.n} groups are more than the {len(groups)} dates")
    splits = [
        (mask, all(groups[g]["n"] == groups[g]["known"] for g in chosen), min(groups[g]["low"] for g in chosen), max(groups[g]["high"] for g in chosen))
        for mask, chosen in zip(plan.masks(), plan.chosen())
    ]
    lists = [F.lit(list(x)).alias(name) for x, name in zip(zip(*splits), ("mask", "known", "low", "high"))]
    each = own.join(meets, day, "left").join(follows, day, "left").select("*", F.posexplode(F.arrays_zip(*lists)).alias("_split", "_s"))
    overlaps = F.col("_a").isNull() | (F.coalesce("_purge", F.lit(0)).bitwiseAND(F.col("_s.mask")) != 0)
    embargoed = F.lit(plan.embargo_days > 0) & (F.coalesce("_embargo", F.lit(0)).bitwiseAND(F.col("_s.mask")) != 0)
    near = F.lit(plan.gap > 0) & F.col("_pos").between(F.col("_s.low") - plan.gap, F.col("_s.high") + plan.gap)
    role = (
        F.when(F.call_function("shiftright", F.col("_s.mask"), F.col("_g")).bitwiseAND(F.lit(1)) == 1, "test")
        .when(F.col("_s.known") & overlaps | ~F.col("_s.known") & near, "purged")
        .when(F.col("_s.known") & embargoed, "embargoed")
        .otherwise("train")
    )
    mode = F.when(F.col("_s.known"), "event_window").otherwise("fallback_gap" if plan.gap else "none")
    return each.select((F.col("_split") + 1).cast("long").alias("split_id"), day, role.alias("role"), mode.alias("purge_mode"))


def splits(found: DataFrame, plan: Plan) -> DataFrame:
    """A row for each split: its groups, its dates by role, how it was purged, and whether it has enough of them."""
    count = lambda role: F.count(F.when(F.col("role") == role, 1))
    out = found.groupBy("split_id").agg(
        count("test").alias("test_dates"), count("train").alias("train_dates"), count("purged").alias("purged_dates"), count("embargoed").alias("embargoed_dates"), F.first("purge_mode").alias("purge_mode")
    )
    names = F.lit(["|".join(map(str, g)) for g in plan.chosen()])
    enough = (F.col("train_dates") >= plan.least_train) & (F.col("test_dates") >= plan.least_test)
    return out.withColumn("test_groups", F.element_at(names, F.col("split_id").cast("int"))).withColumn("status", F.when(enough, "ok").otherwise("insufficient_data"))


def tested(found: DataFrame, plan: Plan, panel: Panel = PANEL) -> DataFrame:
    """path_id, split_id, date: what each path tests, of splits that have enough dates."""
    valid = [r["split_id"] for r in splits(found, plan).filter("status = 'ok'").select("split_id").collect()]  # a row a split
    of = {split: path for path, split in plan.paths(valid)}
    path = F.element_at(F.lit([of.get(s, 0) for s in range(1, len(plan.masks()) + 1)]), F.col("split_id").cast("int"))
    return found.filter("role = 'test'").withColumn("path_id", path.cast("long")).filter("path_id > 0").select("path_id", "split_id", panel.date)


def ridge_of_splits(df: DataFrame, found: DataFrame, features: Sequence[str], target: str, alpha: float, panel: Panel = PANEL) -> DataFrame:
    """split_id, n, intercept, coefficients: a ridge regression of each split's train dates, whose intercept is free.

    Rows with an unknown value are left out. Splits with fewer rows than coefficients have none.
    """
    names = [*features, target]
    full = df.select(panel.date, *(F.col(c).cast("double").alias(c) for c in names)).dropna()
    at = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    sums = [F.count(F.lit(1)).cast("double"), *(F.sum(c) for c in names), *(F.sum(F.col(names[i]) * F.col(names[j])) for i, j in at)]
    days = full.groupBy(panel.date).agg(*(x.alias(f"_s{k}") for k, x in enumerate(sums)))
    trained = found.filter("role = 'train'").select("split_id", panel.date).join(days, panel.date)
    total = trained.groupBy("split_id").agg(F.array(*(F.sum(f"_s{k}") for k in range(len(sums)))).alias("sums"))

    def solve(batches):
        m, f = len(names), len(features)
        for rows in batches:
            out = []
            for split, s in zip(rows["split_id"], rows["sums"]):
                n, first = s[0], np.asarray(s[1 : m + 1])
                square = np.zeros((m, m))
                for (i, j), x in zip(at, s[m + 1 :]):
                    square[i, j] = square[j, i] = x
                if n > f:
                    centred = square - np.outer(first, first) / n
                    b = np.linalg.solve(centred[:f, :f] + alpha * np.eye(f), centred[:f, f])
                    out.append((split, int(n), float(first[f] - b @ first[:f]) / n, b.tolist()))
            yield pd.DataFrame(out, columns=["split_id", "n", "intercept", "coefficients"])

    return total.mapInPandas(solve, "split_id long, n long, intercept double, coefficients array<double>")


def scores(df: DataFrame, paths: DataFrame, fits: DataFrame, features: Sequence[str], target: str, panel: Panel = PANEL) -> DataFrame:
    """path_id, date, entity, pred, target: each row of the panel once in each path that tests its date."""
    days = paths.join(fits, "split_id")  # a row for each path and date
    rows = df.select(*panel.keys, *(F.col(c).cast("double").alias(c) for c in (*features, target))).dropna(subset=list(features)).join(F.broadcast(days), panel.date)
    pred = sum((F.col(c) * F.element_at("coefficients", k) for k, c in enumerate(features, 1)), F.col("intercept"))
    return rows.select("path_id", *panel.keys, pred.alias("pred"), F.col(target).alias("target"))


def path_returns(scored: DataFrame, quantiles: int, panel: Panel = PANEL) -> DataFrame:
    """path_id, date, top, long_short: the mean target of the date's best quantile by pred, and less that of its worst;
    dates with fewer rows than quantiles have none."""
    keys = ["path_id", panel.date]
    full = scored.filter("pred is not null and target is not null").withColumn("_n", F.count(F.lit(1)).over(R.by(*keys)))
    ranked = full.filter(F.col("_n") >= quantiles).withColumn("_q", R.bucket_of_rank(R.first_rank("pred", keys, [panel.entity]), F.col("_n"), quantiles))
    best, worst = (F.avg(F.when(F.col("_q") == q, F.col("target"))) for q in (quantiles - 1, 0))
    return ranked.groupBy(*keys).agg(best.alias("top"), (best - worst).alias("long_short"))


def path_performance(returns: DataFrame, value: str, per_year: float, panel: Panel = PANEL) -> DataFrame:
    """path_id, observations, total_return, ann_return, ann_vol, sharpe, max_drawdown of a return a date and path."""
    w = Window.partitionBy("path_id").orderBy(panel.date).rowsBetween(Window.unboundedPreceding, 0)  # a row a date
    nav = returns.filter(F.col(value).isNotNull()).withColumn("_nav", F.exp(F.sum(F.log1p(value)).over(w)))
    down = nav.withColumn("_down", F.col("_nav") / F.greatest(F.max("_nav").over(w), F.lit(1.0)) - 1)
    n = F.count(F.lit(1)).cast("double")
    dev = F.stddev_samp(value)
    return down.groupBy("path_id").agg(
        F.count(F.lit(1)).alias("observations"), R.compounded(value).alias("total_return"), (F.exp(F.sum(F.log1p(value)) * per_year / n) - 1).alias("ann_return"),
        (dev * per_year**0.5).alias("ann_vol"), (R.ratio(F.avg(value), F.nullif(dev, F.lit(0.0))) * per_year**0.5).alias("sharpe"), F.min("_down").alias("max_drawdown"),
    )


def audit(df: DataFrame, dates: DataFrame, plan: Plan, features: Sequence[str], target: str, alpha: float, quantiles: int = 5, per_year: float = 252.0, panel: Panel = PANEL) -> DataFrame:
    """A row for each path of ridge models: dates and performance of the best quantile, IC and long-short return."""
    found = roles(dates, plan, panel)
    paths = tested(found, plan, panel)
    scored = scores(df, paths, ridge_of_splits(df, found, features, target, alpha, panel), features, target, panel)
    return path_results(scored, paths, quantiles, per_year, panel)


def path_results(scored: DataFrame, paths: DataFrame, quantiles: int = 5, per_year: float = 252.0, panel: Panel = PANEL) -> DataFrame:
    """The rows of ``audit`` of scored rows, however they were scored."""
    returns = path_returns(scored, quantiles, panel)
    ics = dg.summarize_ic(dg.daily_ic(scored, "pred", "target", "spearman", ["path_id"], panel), ["path_id"])
    out = path_performance(returns, "top", per_year, panel).join(returns.groupBy("path_id").agg(F.avg("long_short").alias("long_short")), "path_id")
    out = out.join(ics.select("path_id", F.col("mean").alias("ic_mean"), F.col("ir").alias("ic_ir")), "path_id", "left")
    return out.join(_spans(paths, panel), "path_id")


def _spans(paths: DataFrame, panel: Panel) -> DataFrame:
    """The splits of each path, and its first and last tested date."""
    ids = F.array_join(F.transform(F.sort_array(F.collect_set("split_id")), lambda x: x.cast("string")), "|")
    return paths.groupBy("path_id").agg(ids.alias("split_ids"), F.min(panel.date).alias("test_start"), F.max(panel.date).alias("test_end"))


def frozen_audit(periods: DataFrame, plan: Plan, per_year: float, rebalance: str = "rebalance_date", entry: str = "entry_date", exit_: str = "exit_date", benchmark: str | None = None) -> DataFrame:
    """A row for each path of returns that are there already: periods with net_return, turnover and total_cost, whose
    label window is from entry to exit. Nothing is fitted again: this audits how results depend on the periods chosen.

    per_year: periods a year. With a benchmark's return: active total return, tracking error and information ratio.
    """
    panel = Panel("symbol", rebalance)
    dates = periods.select(rebalance, F.col(entry).alias("label_start"), F.col(exit_).alias("label_end"))
    found = roles(dates, plan, panel)
    paths = tested(found, plan, panel)
    columns = ["net_return", "turnover", "total_cost", *([benchmark] if benchmark else [])]
    rows = paths.join(periods.select(rebalance, *columns), rebalance)
    out = path_performance(rows, "net_return", per_year, panel).join(_spans(paths, panel), "path_id")
    costs = rows.groupBy("path_id", "split_id").agg(F.avg("total_cost").alias("_c")).groupBy("path_id").agg(F.avg("_c").alias("avg_cost_drag"))
    out = out.join(rows.groupBy("path_id").agg(F.avg("turnover").alias("avg_turnover")), "path_id").join(costs, "path_id")
    if benchmark:
        active = rows.withColumn("_x", F.col("net_return") - F.col(benchmark)).filter("_x is not null")
        dev = F.stddev_samp("_x") * per_year**0.5
        out = out.join(
            active.groupBy("path_id").agg(R.compounded("_x").alias("active_total_return"), dev.alias("tracking_error"), R.ratio(F.avg("_x") * per_year, F.nullif(dev, F.lit(0.0))).alias("information_ratio")),
            "path_id",
            "left",
        )
    return out


def summary(paths: DataFrame) -> DataFrame:
    """One row: how the paths' results spread, of those columns that are there."""
    out = [F.count(F.lit(1)).alias("valid_path_count")]
    if "sharpe" in paths.columns:
        s = "sharpe"
        out += [F.avg(s).alias("sharpe_mean"), F.percentile(s, 0.5).alias("sharpe_median"), F.percentile(s, 0.25).alias("sharpe_p25"), F.percentile(s, 0.1).alias("sharpe_p10"), F.min(s).alias("sharpe_min")]
        out.append(F.avg((F.col(s) > 0).cast("double")).alias("positive_sharpe_ratio"))
    middle = {"ic_mean": "ic_median", "long_short": "long_short_median", "avg_turnover": "turnover_median", "avg_cost_drag": "cost_drag_median"}
    out += [F.percentile(c, 0.5).alias(name) for c, name in middle.items() if c in paths.columns]
    if "max_drawdown" in paths.columns:
        out.append(F.percentile(F.abs("max_drawdown"), 0.1).alias("max_drawdown_p10"))
    return paths.agg(*out)
