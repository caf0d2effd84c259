"""Diagnostics of signals and factors: correlations with what follows, drift, exposure, turnover, performance."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomspark.functions import recipes as R
from loomspark.operators.panel import PANEL, Panel, calendar


def with_ranks(df: DataFrame, pairs: Sequence[tuple[str, str]], group: Sequence[str]) -> DataFrame:
    """Average ranks of the rows where both of a pair are known, as columns _a0, _b0 …"""
    for k, (x, y) in enumerate(pairs):
        both = F.col(x).isNotNull() & F.col(y).isNotNull()
        df = df.withColumn(f"_x{k}", F.when(both, F.col(x))).withColumn(f"_y{k}", F.when(both, F.col(y)))
        df = df.withColumn(f"_a{k}", R.average_rank(f"_x{k}", group)).withColumn(f"_b{k}", R.average_rank(f"_y{k}", group)).drop(f"_x{k}", f"_y{k}")
    return df


def daily_ic(df: DataFrame, score: str, target: str, method: str = "spearman", group: Sequence[str] = (), panel: Panel = PANEL) -> DataFrame:
    """ic of each date (and group) with two different targets at least, where it is defined."""
    keys = [panel.date, *group]
    if method == "spearman":
        ranked = with_ranks(df, [(score, target)], keys)
        ic = R.pearson("_a0", "_b0")
    else:
        ranked, ic = df, R.pearson(score, target)
    both = F.col(score).isNotNull() & F.col(target).isNotNull()
    known = F.when(both, F.col(target))
    varied = F.min(known) < F.max(known)  # two different ones, without a table of all
    found = ranked.groupBy(*keys).agg(ic.alias("ic"), varied.alias("_varied"), F.count(known).alias("n_obs"))
    return found.filter("_varied and ic is not null").drop("_varied")


def summarize_ic(ics: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """n, mean, deviation, information ratio and t of the series."""
    found = ics.groupBy(*group).agg(F.count("ic").alias("n"), F.avg("ic").alias("mean"), F.stddev_pop("ic").alias("std"))
    found = found.withColumn("ir", R.ratio("mean", F.nullif(F.col("std"), F.lit(0.0))))
    return found.withColumn("t_stat", F.col("ir") * F.sqrt(F.col("n").cast("double")))


def quantile_returns(df: DataFrame, score: str, target: str, n: int, panel: Panel = PANEL) -> DataFrame:
    """The mean target of each date and score quantile, of dates with n rows at least."""
    full = df.filter(F.col(score).isNotNull() & F.col(target).isNotNull())
    count = F.count(F.lit(1)).over(R.by(panel.date))
    ranked = full.withColumn("_n", count).withColumn("_r", R.first_rank(score, [panel.date], [panel.entity])).filter(F.col("_n") >= n)
    ranked = ranked.withColumn("quantile", R.bucket_of_rank(F.col("_r"), F.col("_n"), n))
    return ranked.groupBy(panel.date, "quantile").agg(F.avg(target).alias("mean_target"), F.count(F.lit(1)).alias("n_obs"))


def quantile_bucket(df: DataFrame, value: str, n: int, out: str = "bucket", panel: Panel = PANEL) -> DataFrame:
    """The date's quantile of each row; NULL on dates with fewer different values than bins."""
    w = R.by(panel.date)
    distinct = F.max(F.dense_rank().over(w.orderBy(F.col(value).asc_nulls_first()))).over(w) - F.max(F.col(value).isNull().cast("int")).over(w)
    rank = R.first_rank(value, [panel.date], [panel.entity])
    return df.withColumn(out, F.when(F.col(value).isNotNull() & (distinct >= n), R.bucket_of_rank(rank, F.count(value).over(w), n)))


def errors(df: DataFrame, actual: str, predicted: str, group: Sequence[str] = ()) -> DataFrame:
    """n, mean absolute and root mean square error, R squared, and the share of equal signs."""
    full = df.filter(F.col(actual).isNotNull() & F.col(predicted).isNotNull())
    e = F.col(actual) - F.col(predicted)
    same = F.signum(actual) == F.signum(predicted)
    return full.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"),
        (1 - R.ratio(F.sum(e * e), F.nullif(F.var_pop(actual) * F.count(F.lit(1)), F.lit(0.0)))).alias("r2"),
        F.avg(same.cast("double")).alias("hit_rate"),
    )


def top_k_positive(df: DataFrame, score: str, target: str, k: int, panel: Panel = PANEL) -> DataFrame:
    """The mean over dates of the share of positive targets among the k best scores."""
    full = df.filter(F.col(score).isNotNull() & F.col(target).isNotNull())
    best = full.withColumn("_r", R.first_rank(score, [panel.date], [panel.entity], descending=True)).filter(F.col("_r") <= k)
    days = best.groupBy(panel.date).agg(F.avg((F.col(target) > 0).cast("double")).alias("share"))
    return days.agg(F.avg("share").alias("positive_ratio"), F.count(F.lit(1)).alias("n_dates"))


def active_returns(series: DataFrame, strategy: str, benchmark: str, per_year: float) -> DataFrame:
    """Active mean, tracking error, information ratio, beta, alpha, correlation and total of two return series."""
    full = series.filter(F.col(strategy).isNotNull() & F.col(benchmark).isNotNull()).withColumn("_a", F.col(strategy) - F.col(benchmark))
    found = full.agg(
        F.count(F.lit(1)).alias("n"), (F.avg("_a") * per_year).alias("active_mean"), (F.stddev_samp("_a") * F.sqrt(F.lit(per_year))).alias("tracking_error"),
        F.regr_slope(strategy, benchmark).alias("beta"), R.pearson(strategy, benchmark).alias("corr"), R.compounded("_a").alias("active_total"),
        F.avg(strategy).alias("_s"), F.avg(benchmark).alias("_b"),
    )
    return found.withColumn("information_ratio", R.ratio("active_mean", F.nullif(F.col("tracking_error"), F.lit(0.0)))).withColumn("alpha", (F.col("_s") - F.col("beta") * F.col("_b")) * per_year).drop("_s", "_b")


def period_returns(series: DataFrame, value: str, date: str, per_year: float) -> DataFrame:
    """Total and yearly return, risk ratios, drawdown, moments and tail loss of one return series.

    The path needs one ordered window: the series has a row a date, not one an entity.
    """
    w = Window.orderBy(date).rowsBetween(Window.unboundedPreceding, 0)
    path = series.filter(F.col(value).isNotNull()).withColumn("_nav", F.exp(F.sum(F.log1p(value)).over(w)))
    path = path.withColumn("_top", F.greatest(F.max("_nav").over(w), F.lit(1.0))).withColumn("_dd", F.col("_nav") / F.col("_top") - 1)
    cut = path.agg(F.percentile(value, 0.05).alias("_var"))
    path = path.join(F.broadcast(cut), how="left").withColumn("_tail", F.when(F.col(value) <= F.col("_var") + 1e-9, F.col(value)))  # one row; of equal returns all or none
    n = F.count(F.lit(1)).cast("double")
    loss = F.sqrt(F.avg(F.pow(F.least(F.col(value), F.lit(0.0)), F.lit(2.0))))
    found = path.agg(
        F.count(F.lit(1)).alias("n"), R.compounded(value).alias("total_return"), (F.exp(F.sum(F.log1p(value)) * per_year / n) - 1).alias("annual_return"),
        (F.stddev_samp(value) * F.sqrt(F.lit(per_year))).alias("volatility"), (R.ratio(F.avg(value), F.nullif(F.stddev_samp(value), F.lit(0.0))) * F.sqrt(F.lit(per_year))).alias("sharpe"),
        (R.ratio(F.avg(value), F.nullif(loss, F.lit(0.0))) * F.sqrt(F.lit(per_year))).alias("sortino"), F.min("_dd").alias("max_drawdown"),
        R.skewness(value).alias("skew"), R.kurtosis(value).alias("kurt"), F.first("_var").alias("var_95"), F.avg("_tail").alias("cvar_95"),
    )
    return found.withColumn("calmar", R.ratio("annual_return", F.nullif(-F.col("max_drawdown"), F.lit(0.0))))


def unpivot(df: DataFrame, factors: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """A row for each of the factors: factor, value."""
    return df.unpivot(list(keep), list(factors), "factor", "value")


def factor_dates(df: DataFrame, factors: Sequence[str], target: str, least: int = 2, panel: Panel = PANEL) -> DataFrame:
    """coverage, rank correlation with the target, mean and deviation of each date and factor."""
    long = with_ranks(unpivot(df, factors, [*panel.keys, target]), [("value", target)], [panel.date, "factor"])
    ic = F.when(F.count("_a0") >= least, R.pearson("_a0", "_b0"))
    return long.groupBy(panel.date, "factor").agg(F.avg(F.col("value").isNotNull().cast("double")).alias("coverage"), ic.alias("rank_ic"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))


def factor_drift(df: DataFrame, factors: Sequence[str], lag: int, panel: Panel = PANEL) -> DataFrame:
    """Rank correlation of each factor with itself ``lag`` dates before, over the entities that both have."""
    days = calendar(df, panel)
    long = unpivot(df, factors, panel.keys).filter("value is not null").join(F.broadcast(days), panel.date)
    before = long.select(panel.entity, "factor", (F.col("position") + lag).alias("position"), F.col("value").alias("before"))
    both = with_ranks(long.join(before, [panel.entity, "factor", "position"]), [("value", "before")], [panel.date, "factor"])
    return both.groupBy(panel.date, "factor").agg(F.count(F.lit(1)).alias("n_obs"), R.pearson("_a0", "_b0").alias("autocorrelation"))


def bucket_diagnostics(df: DataFrame, factors: Sequence[str], target: str, bucket: str, panel: Panel = PANEL) -> DataFrame:
    """Rank correlation and mean target spread of each factor within each bucket (size, industry …) of each date."""
    keys = [panel.date, "factor", bucket]
    long = unpivot(df, factors, [*panel.keys, target, bucket]).filter(F.col("value").isNotNull() & F.col(target).isNotNull() & F.col(bucket).isNotNull())
    ranked = with_ranks(long, [("value", target)], keys)
    n, r = F.count(F.lit(1)).over(R.by(*keys)), R.first_rank("value", keys, [panel.entity])
    ranked = ranked.withColumn("_leg", F.when(r > n - F.ceil(n * 0.2), 1).when(r <= F.ceil(n * 0.2), -1))
    spread = F.avg(F.when(F.col("_leg") == 1, F.col(target))) - F.avg(F.when(F.col("_leg") == -1, F.col(target)))
    return ranked.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_obs"), R.pearson("_a0", "_b0").alias("rank_ic"), spread.alias("long_short"))


def factor_correlations(df: DataFrame, factors: Sequence[str], panel: Panel = PANEL) -> DataFrame:
    """The mean over dates of the rank correlation of each pair of factors, pairwise complete."""
    pairs = [(a, b) for k, a in enumerate(factors) for b in factors[k + 1 :]]
    ranked = with_ranks(df, pairs, [panel.date])
    days = ranked.groupBy(panel.date).agg(*(R.pearson(f"_a{k}", f"_b{k}").alias(f"_c{k}") for k in range(len(pairs))))
    found = days.agg(*(F.struct(F.lit(a).alias("left_factor"), F.lit(b).alias("right_factor"), F.avg(f"_c{k}").alias("mean_corr"), F.count(f"_c{k}").alias("n_dates")).alias(f"_p{k}") for k, (a, b) in enumerate(pairs)))
    return found.select(F.inline(F.array(*(f"_p{k}" for k in range(len(pairs))))))


def clusters(pairs: Sequence[tuple[str, str, float]], threshold: float) -> list[list[str]]:
    """Groups of factors that correlations at or above the threshold connect; a few tens of names."""
    root: dict[str, str] = {}

    def find(x: str) -> str:
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b, c in pairs:
        x, y = find(a), find(b)
        if c is not None and abs(c) >= threshold:
            root[max(x, y)] = min(x, y)
    groups: dict[str, list[str]] = {}
    for x in sorted(root):
        groups.setdefault(find(x), []).append(x)
    return sorted(groups.values())


def exposure_residuals(df: DataFrame, factor: str, target: str, styles: Sequence[str], industry: str | None = None, least: int = 10, panel: Panel = PANEL) -> DataFrame:
    """R squared of a factor on styles and industries by date, and the rank correlation of what is left with the target."""

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        date = group[panel.date].iloc[0]
        full = group.dropna(subset=[factor, target, *styles])
        if len(full) < least:
            return pd.DataFrame({panel.date: [date], "n_obs": [len(full)], "r2": [np.nan], "residual_ic": [np.nan]})
        parts = [np.ones((len(full), 1)), full[list(styles)].to_numpy(float)]
        if industry:
            parts.append(pd.get_dummies(full[industry], drop_first=True).to_numpy(float))
        a, y = np.column_stack(parts), full[factor].to_numpy(float)
        left = y - a @ np.linalg.lstsq(a, y, rcond=None)[0]
        spread = ((y - y.mean()) ** 2).sum()
        ic = pd.Series(left).rank().corr(full[target].reset_index(drop=True).rank())
        return pd.DataFrame({panel.date: [date], "n_obs": [len(full)], "r2": [1 - (left**2).sum() / spread if spread > 0 else np.nan], "residual_ic": [ic]})

    kind = df.schema[panel.date].dataType.simpleString()
    columns = [panel.date, factor, target, *styles, *([industry] if industry else [])]
    return df.select(*columns).groupBy(panel.date).applyInPandas(fit, f"{panel.date} {kind}, n_obs long, r2 double, residual_ic double")


def churn(df: DataFrame, score: str, k: int, panel: Panel = PANEL) -> DataFrame:
    """One less the share of each date's k best that the date before had, of dates that both have k."""
    best = df.filter(F.col(score).isNotNull()).withColumn("_r", R.first_rank(score, [panel.date], [panel.entity], descending=True)).filter(F.col("_r") <= k).select(*panel.keys)
    full = best.groupBy(panel.date).count().filter(F.col("count") == k).select(panel.date)
    days = calendar(df, panel).join(full, panel.date, "left_semi")
    held = best.join(F.broadcast(days), panel.date)
    before = held.select(panel.entity, (F.col("position") + 1).alias("position"), F.lit(1).alias("again"))
    pairs = days.join(days.select((F.col("position") + 1).alias("position")), "position", "left_semi")
    kept = held.join(before, [panel.entity, "position"]).groupBy(panel.date).agg(F.sum("again").alias("again"))
    return pairs.select(panel.date).join(kept, panel.date, "left").withColumn("churn", 1 - F.coalesce("again", F.lit(0)) / F.lit(float(k))).drop("again")


def signal_drift(reference: DataFrame, current: DataFrame, value: str, bins: int = 10) -> DataFrame:
    """Population stability by the reference's quantiles, Kolmogorov-Smirnov distance, and shifts of mean and deviation."""
    both = reference.select(F.col(value).alias("v"), F.lit(1).alias("ref")).union(current.select(F.col(value).alias("v"), F.lit(0).alias("ref"))).filter("v is not null")
    edges = reference.agg(F.percentile(value, [k / bins for k in range(1, bins)]).alias("edges"))
    n = both.agg(F.sum("ref").alias("n_ref"), F.sum(1 - F.col("ref")).alias("n_cur"))
    base = edges.join(n, how="left")  # one row
    bucket = F.size(F.filter(F.array_distinct("edges"), lambda e: e < F.col("v")))
    counted = both.join(F.broadcast(base), how="left").groupBy(bucket.alias("b"), "n_ref", "n_cur").agg(F.sum("ref").alias("r"), F.sum(1 - F.col("ref")).alias("c"))
    p, q = F.greatest(F.col("r") / F.col("n_ref"), F.lit(1e-6)), F.greatest(F.col("c") / F.col("n_cur"), F.lit(1e-6))
    psi = counted.agg(F.sum((q - p) * F.log(q / p)).alias("psi"))
    steps = both.groupBy("v").agg(F.sum("ref").alias("r"), F.sum(1 - F.col("ref")).alias("c"))
    # running counts: one window in each of some ranges of values, after the totals of the ranges before
    cuts = both.agg(F.percentile_approx("v", [k / 64 for k in range(1, 64)], 1000).alias("cuts"))
    ranged = steps.join(F.broadcast(cuts), how="left").withColumn("range", F.size(F.filter(F.array_distinct("cuts"), lambda e: e < F.col("v")))).drop("cuts")
    ordered = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    before = ranged.groupBy("range").agg(F.sum("r").alias("r"), F.sum("c").alias("c")).select("range", F.coalesce(F.sum("r").over(ordered), F.lit(0)).alias("br"), F.coalesce(F.sum("c").over(ordered), F.lit(0)).alias("bc"))
    w = Window.partitionBy("range").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    ks = ranged.withColumn("cr", F.sum("r").over(w)).withColumn("cc", F.sum("c").over(w)).join(F.broadcast(before), "range").withColumn("cr", F.col("cr") + F.col("br")).withColumn("cc", F.col("cc") + F.col("bc")).join(F.broadcast(n), how="left").agg(F.max(F.abs(F.col("cr") / F.col("n_ref") - F.col("cc") / F.col("n_cur"))).alias("ks"))
    moments = both.agg(
        F.avg(F.when(F.col("ref") == 1, F.col("v"))).alias("ref_mean"), F.avg(F.when(F.col("ref") == 0, F.col("v"))).alias("cur_mean"),
        F.stddev_samp(F.when(F.col("ref") == 1, F.col("v"))).alias("ref_std"), F.stddev_samp(F.when(F.col("ref") == 0, F.col("v"))).alias("cur_std"),
    )
    shift = R.ratio(F.col("cur_mean") - F.col("ref_mean"), F.nullif(F.col("ref_std"), F.lit(0.0)))
    return psi.join(ks, how="left").join(moments, how="left").withColumn("mean_shift_std", shift).withColumn("std_ratio", R.ratio("cur_std", F.nullif(F.col("ref_std"), F.lit(0.0))))


def availability(df: DataFrame, features: Sequence[str], panel: Panel = PANEL) -> DataFrame:
    """Rows, dates, complete rows, and missing values of each feature, in one pass."""
    complete = F.lit(True)
    for f in features:
        complete &= F.col(f).isNotNull()
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"), F.countDistinct(panel.date).alias("n_dates"), F.count(F.when(complete, 1)).alias("complete_rows"),
        F.countDistinct(F.when(complete, F.col(panel.date))).alias("complete_dates"), *(F.count(F.when(F.col(f).isNull(), 1)).alias(f"missing_{f}") for f in features),
    )


def rolling_factor_stats(ics: DataFrame, n: int, least: int, date: str = "trade_date") -> DataFrame:
    """Rolling mean, information ratio (NULL where the series does not vary) and share of the mean's sign of each
    factor's series, known the date after."""
    h = Window.partitionBy("factor").orderBy(date)
    w = h.rowsBetween(1 - n, 0)
    mean, std = R.rolling(F.avg("rank_ic"), w, "rank_ic", least), R.rolling(F.stddev_samp("rank_ic"), w, "rank_ic", least)
    up = R.rolling(F.avg(F.when(F.col("rank_ic").isNotNull(), (F.col("rank_ic") > 0).cast("double"))), w, "rank_ic", least)
    found = ics.withColumn("_m", mean).withColumn("_i", F.when(std > 1e-9, mean / std)).withColumn("_u", F.greatest(up, 1 - up))
    return found.withColumns({o: F.lag(c).over(h) for o, c in (("rolling_ic", "_m"), ("rolling_icir", "_i"), ("consistency", "_u"))}).drop("_m", "_i", "_u")
