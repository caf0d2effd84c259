"""Inference on short series: one value a date, a period or a trial. Plain Python on the driver, but for the sums.

What grows with the data (sums by group of dates and candidate) is aggregated by Spark; what is left has as many
numbers as there are dates, folds or candidates.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import combinations
from statistics import NormalDist

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomspark.functions import recipes as R


def newey_west(values: Sequence[float], lag: int | None = None, least_lag: int = 0) -> dict[str, float]:
    """Mean, its error with Bartlett weights, t and two-sided normal p of a series."""
    x = [v for v in values if v is not None and math.isfinite(v)]
    n = len(x)
    if n < 2:
        return {"n": n, "mean": x[0] if x else math.nan, "error": math.nan, "t": math.nan, "p": math.nan, "lag": 0}
    mean = math.fsum(x) / n
    lag = min(n - 1, max(least_lag, int(4 * (n / 100) ** (2 / 9)) if lag is None else lag))
    e = [v - mean for v in x]
    total = math.fsum(v * v for v in e) + 2 * sum((1 - k / (lag + 1)) * math.fsum(a * b for a, b in zip(e[k:], e)) for k in range(1, lag + 1))
    error = math.sqrt(max(total, 0.0)) / n
    t = mean / error if error > 0 else math.nan
    return {"n": n, "mean": mean, "error": error, "t": t, "p": math.erfc(abs(t) / math.sqrt(2)) if error > 0 else math.nan, "lag": lag}


def newey_west_of(series: DataFrame, value: str, date: str, lag: int | None = None, group: Sequence[str] = ()) -> DataFrame:
    """n, mean, error, t, lag of each group's series, as ``newey_west``: a row a date, and lagged sums in one window.

    lag: fixed, or by the length of the series, up to 24 lags. Series of fewer than two values have no error.
    """
    most = 24 if lag is None else lag
    each = Window.partitionBy(*group)
    full = series.withColumn("_x", R.clean(value)).filter("_x is not null")
    e = full.withColumn("_e", F.col("_x") - F.avg("_x").over(each))
    order = each.orderBy(date)
    lagged = e.select(*group, "_x", "_e", *(F.lag("_e", k).over(order).alias(f"_l{k}") for k in range(1, most + 1)))
    sums = lagged.groupBy(*group).agg(F.count("_x").alias("n"), F.avg("_x").alias("mean"), F.sum(F.col("_e") * F.col("_e")).alias("_s0"), *(F.coalesce(F.sum(F.col("_e") * F.col(f"_l{k}")), F.lit(0.0)).alias(f"_s{k}") for k in range(1, most + 1)))
    wanted = F.floor(4 * F.pow(F.col("n") / 100.0, F.lit(2 / 9))) if lag is None else F.lit(lag)
    sums = sums.withColumn("lag", F.when(F.col("n") < 2, 0).otherwise(F.least(F.col("n") - 1, wanted, F.lit(most))).cast("long"))
    weighted = sum((F.when(F.col("lag") >= k, (1 - k / (F.col("lag") + 1)) * F.col(f"_s{k}")).otherwise(0.0) for k in range(1, most + 1)), F.lit(0.0))
    error = F.when(F.col("n") >= 2, F.sqrt(F.greatest(F.col("_s0") + 2 * weighted, F.lit(0.0))) / F.col("n"))
    return sums.withColumn("error", error).select(*group, "n", "mean", "error", R.ratio("mean", F.nullif(F.col("error"), F.lit(0.0))).alias("t"), "lag")


def holm(p_values: Sequence[float]) -> list[float]:
    """Step-down adjusted p values, in the order given."""
    n, out, worst = len(p_values), [0.0] * len(p_values), 0.0
    for k, i in enumerate(sorted(range(n), key=lambda i: p_values[i])):
        worst = out[i] = max(worst, min(1.0, (n - k) * p_values[i]))
    return out


def deflated_sharpe(sharpe: float, n: int, trials: int, variance: float, skew: float = 0.0, kurt: float = 3.0) -> float:
    """The chance that a Sharpe ratio (of one period) beats the best of so many trials without skill."""
    normal = NormalDist()
    gamma = 0.5772156649015329
    best = math.sqrt(variance) * ((1 - gamma) * normal.inv_cdf(1 - 1 / trials) + gamma * normal.inv_cdf(1 - 1 / (trials * math.e))) if trials > 1 else 0.0
    spread = math.sqrt(max(1e-12, (1 - skew * sharpe + (kurt - 1) / 4 * sharpe**2) / (n - 1)))
    return normal.cdf((sharpe - best) / spread)


def group_sums(returns: DataFrame, date: str, candidate: str, value: str, groups: int) -> DataFrame:
    """n, sum and sum of squares of each candidate in each of some groups of consecutive dates."""
    dates = returns.select(date).distinct()
    w = Window.orderBy(date)
    placed = dates.withColumn("group", F.floor((F.row_number().over(w) - 1) * groups / F.count(F.lit(1)).over(Window.partitionBy())).cast("int"))
    joined = returns.join(F.broadcast(placed), date)
    return joined.groupBy("group", candidate).agg(F.count(value).alias("n"), F.sum(value).alias("s"), F.sum(F.col(value) * F.col(value)).alias("q"))


def overfitting_probability(sums: Sequence[tuple[int, str, int, float, float]], groups: int) -> dict[str, float]:
    """The share of splits of the groups in which the best candidate of one half is below the median of the other.

    sums: group, candidate, n, sum, sum of squares, as group_sums has them.
    """
    table: dict[str, dict[int, tuple[int, float, float]]] = {}
    for g, c, n, s, q in sums:
        table.setdefault(c, {})[g] = n, s, q

    def sharpe(candidate: str, chosen: Sequence[int]) -> float:
        n, s, q = (sum(x) for x in zip(*(table[candidate].get(g, (0, 0.0, 0.0)) for g in chosen)))
        spread = (q - s * s / n) / (n - 1) if n > 1 else 0
        return s / n / math.sqrt(spread) if spread > 0 else 0.0

    names, logits = sorted(table), []
    for train in combinations(range(groups), groups // 2):
        test = [g for g in range(groups) if g not in train]
        best = max(names, key=lambda c: (sharpe(c, train), c))
        scores = {c: sharpe(c, test) for c in names}
        rank = sum(s < scores[best] for s in scores.values()) + (sum(s == scores[best] for s in scores.values()) + 1) / 2
        share = rank / (len(names) + 1)
        logits.append(math.log(share / (1 - share)))
    return {"splits": len(logits), "pbo": sum(x <= 0 for x in logits) / len(logits), "mean_logit": sum(logits) / len(logits)}


def overfitting_splits(sums: DataFrame, groups: int, candidate: str = "candidate") -> DataFrame:
    """split, best, train_sharpe, test_sharpe, relative_rank, logit: each choice of half of the groups to train on.

    sums: as group_sums has them. split has a bit for each group trained on. best has the highest Sharpe ratio there
    (of equal ones the last by name); its rank by that of the other groups, over candidates and one, is below a half
    where choosing it was overfitting. Ratios without a deviation are 0.
    """
    halves = [m for m in range(1 << groups) if m.bit_count() == groups // 2]
    rows = sums.withColumn("split", F.explode(F.array(*(F.lit(m) for m in halves))))
    trained = F.getbit("split", F.col("group").cast("int")) == 1

    def sharpe(chosen):
        n, s, q = (F.sum(F.when(chosen, F.col(c))) for c in ("n", "s", "q"))
        spread = (q - s * s / n) / (n - 1)
        return F.coalesce(F.when((n > 1) & (spread > 0), s / n / F.sqrt(spread)), F.lit(0.0))

    each = rows.groupBy("split", candidate).agg(sharpe(trained).alias("train_sharpe"), sharpe(~trained).alias("test_sharpe"))
    of_split = Window.partitionBy("split")
    ranked = each.withColumns({"_rank": R.average_rank("test_sharpe", ["split"]), "_n": F.count(F.lit(1)).over(of_split), "_best": F.row_number().over(of_split.orderBy(F.desc("train_sharpe"), F.desc(candidate)))})
    best = ranked.filter("_best = 1").withColumn("relative_rank", F.col("_rank") / (F.col("_n") + 1))
    return best.select("split", F.col(candidate).alias("best"), "train_sharpe", "test_sharpe", "relative_rank", F.log(F.col("relative_rank") / (1 - F.col("relative_rank"))).alias("logit"))


def covariance(returns: DataFrame, factors: Sequence[str], shrinkage: float = 0.0) -> DataFrame:
    """left_factor, right_factor, covariance of factor returns over rows where all are known, shrunk to the diagonal."""
    full = returns.dropna(subset=list(factors))
    pairs = [(a, b) for k, a in enumerate(factors) for b in factors[k:]]
    sums = full.agg(*(F.struct(F.lit(a).alias("left_factor"), F.lit(b).alias("right_factor"), (F.covar_samp(a, b) * (1.0 if a == b else 1 - shrinkage)).alias("covariance"), F.count(F.lit(1)).alias("n_obs")).alias(f"_p{k}") for k, (a, b) in enumerate(pairs)))
    return sums.select(F.inline(F.array(*(f"_p{k}" for k in range(len(pairs))))))


def skill_gate(history: DataFrame, formation: str, mature: str, decision, actual: str, model: str, control: str, least_rows: int = 20, least_formations: int = 8, least_share: float = 0.6) -> DataFrame:
    """Whether a model's squared error beat a control's in enough formations that were known by the decision date."""
    known = history.filter(F.col(mature) <= F.lit(decision).cast("date"))
    gain = F.pow(F.col(actual) - F.col(control), F.lit(2.0)) - F.pow(F.col(actual) - F.col(model), F.lit(2.0))
    each = known.groupBy(formation).agg(F.avg(gain).alias("gain"), F.count(gain).alias("n")).filter(F.col("n") >= least_rows)
    found = each.agg(F.count(F.lit(1)).alias("formations"), F.avg("gain").alias("mean_gain"), F.avg((F.col("gain") > 0).cast("double")).alias("win_share"))
    return found.withColumn("passes", F.coalesce((F.col("formations") >= least_formations) & (F.col("mean_gain") > 0) & (F.col("win_share") >= least_share), F.lit(False)))


def rolling_series(series: DataFrame, value: str, date: str, n: int, per_year: float) -> DataFrame:
    """Rolling mean and Sharpe ratio of one series, from n values on."""
    w = Window.orderBy(date).rowsBetween(1 - n, 0)  # a row a date
    mean, spread = R.rolling(F.avg(value), w, value, n), R.rolling(F.stddev_samp(value), w, value, n)
    return series.withColumn("rolling_mean", mean).withColumn("rolling_sharpe", R.ratio(mean, F.nullif(spread, F.lit(0.0))) * F.sqrt(F.lit(per_year)))
