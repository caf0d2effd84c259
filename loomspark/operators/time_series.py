"""Features along each entity's history. Windows count rows; those over the calendar are frames of date positions."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from loomspark.functions import recipes as R
from loomspark.operators.panel import PANEL, Panel, calendar


def roll(df: DataFrame, column: str, n: int, operation: str, least: int, out: str, shift: int = 0, panel: Panel = PANEL) -> DataFrame:
    """A rolling mean, sum, std (sample), std0, min, max or median with a least number of values, shifted back if asked for."""
    w = panel.last(n)
    if operation == "median":
        value = R.rolling_median(column, w)
        value = F.when(F.count(column).over(w) >= least, value)
    else:
        of = {"mean": F.avg, "sum": F.sum, "std": F.stddev_samp, "std0": F.stddev_pop, "min": F.min, "max": F.max}[operation]
        value = R.rolling(of(F.col(column)), w, column, least)
    df = df.withColumn(out, value)
    return df.withColumn(out, F.lag(out, shift).over(panel.history())) if shift else df


def price_features(df: DataFrame, close: str = "close", high: str = "high", low: str = "low", panel: Panel = PANEL) -> DataFrame:
    """Returns, momentum, volatility, downside deviation, day range and where the close is in it."""
    h = panel.history()
    df = df.withColumn("ret_1d", R.pct_change(close, h)).withColumns({f"mom_{n}": R.pct_change(close, h, n) for n in (5, 20, 60, 120)})
    for n, least in ((5, 3), (20, 10), (60, 30)):
        df = roll(df, "ret_1d", n, "std", least, f"vol_{n}", panel=panel)
    df = df.withColumn("_loss", F.when(F.col("ret_1d").isNotNull(), F.pow(F.least(F.col("ret_1d"), F.lit(0.0)), F.lit(2.0))))
    df = df.withColumn("downside_vol_20", F.sqrt(R.rolling(F.avg("_loss"), panel.last(20), "_loss", 10))).drop("_loss")
    spread = F.col(high) - F.col(low)
    return df.withColumn("range_pct", R.ratio(spread, close)).withColumn("close_location", R.ratio(F.col(close) - F.col(low), F.nullif(spread, F.lit(0.0))))


def liquidity_style(df: DataFrame, amount: str, turnover: str, cap: str, inverse: Sequence[str] = (), target: Column | None = None, panel: Panel = PANEL) -> DataFrame:
    """Mean log amount and turnover, log size, yields, and percent ranks of them within the target rows."""
    df = df.withColumn("_log", F.log1p(F.col(amount)))
    df = roll(df, "_log", 20, "mean", 10, "log_amount_20", panel=panel).drop("_log")
    df = roll(df, turnover, 20, "mean", 10, "turnover_20", panel=panel)
    df = df.withColumn("size_log", F.when(F.col(cap) > 0, F.log(F.col(cap)))).withColumns({f"yield_{c}": F.when(F.col(c) > 0, R.ratio(F.lit(1.0), c)) for c in inverse})
    ranked = ["log_amount_20", "turnover_20", "size_log", *(f"yield_{c}" for c in inverse)]
    return df.withColumns({f"{c}_rank": R.percent_rank(F.when(target, F.col(c)) if target is not None else c, [panel.date]) for c in ranked})


def adjacent_returns(df: DataFrame, price: str, tradable: str, out: str = "adjacent_return", panel: Panel = PANEL) -> DataFrame:
    """The return from the previous row where that is the previous date of the calendar and both were tradable."""
    h = panel.history()
    df = df.join(F.broadcast(calendar(df, panel)), panel.date)
    next_to = (F.col("position") - F.lag("position").over(h) == 1) & F.col(tradable) & F.lag(tradable).over(h)
    return df.withColumn(out, F.when(next_to, R.pct_change(price, h))).drop("position")


def market_return(df: DataFrame, returns: str, out: str = "market_return", panel: Panel = PANEL) -> DataFrame:
    """The equal-weight mean return of each date, joined back."""
    means = df.groupBy(panel.date).agg(F.avg(returns).alias(out))
    return df.join(F.broadcast(means), panel.date, "left")  # as many rows as dates


def rolling_slope(df: DataFrame, y: str, x: str, n: int, least: int, out: str, on_calendar: bool = False, panel: Panel = PANEL) -> DataFrame:
    """The least-squares slope of y on x over the last n rows, or n dates of the calendar, with enough pairs."""
    source, w = on_positions(df, n, panel) if on_calendar else (df, panel.last(n))
    both = F.col(y).isNotNull() & F.col(x).isNotNull()
    a, b = F.when(both, F.col(x)), F.when(both, F.col(y))
    slope = F.when((F.count(b).over(w) >= least) & (F.var_pop(a).over(w) > 1e-18), F.regr_slope(b, a).over(w))
    return source.withColumn(out, slope).select(*df.columns, out)


def on_positions(df: DataFrame, n: int, panel: Panel = PANEL) -> tuple[DataFrame, WindowSpec]:
    """The rows with their date's position in the calendar, and the window of each entity's rows in the last n dates:
    dates without a row add nothing, so that none has to be made."""
    placed = df.join(F.broadcast(calendar(df, panel)), panel.date)  # as many rows as dates
    return placed, Window.partitionBy(panel.entity).orderBy("position").rangeBetween(1 - n, 0)


def residual_volatility(df: DataFrame, y: str, x: str, n: int, least: int, out: str, panel: Panel = PANEL) -> DataFrame:
    """The sample deviation of what a rolling regression of y on x leaves."""
    both = F.col(y).isNotNull() & F.col(x).isNotNull()
    a, b = F.when(both, F.col(x)), F.when(both, F.col(y))
    w = panel.last(n)
    count = F.count(b).over(w)
    left = F.regr_syy(b, a).over(w) - R.ratio(F.pow(F.regr_sxy(b, a).over(w), F.lit(2.0)), F.regr_sxx(b, a).over(w))
    return df.withColumn(out, F.when(count >= least, F.sqrt(F.greatest(left, F.lit(0.0)) / (count - 1))))


def volatility_convergence(df: DataFrame, returns: str, short: tuple[int, int], long: tuple[int, int], out: str, panel: Panel = PANEL) -> DataFrame:
    """Minus the ratio of a short to a long rolling deviation."""
    df = roll(df, returns, short[0], "std", short[1], "_s", panel=panel)
    df = roll(df, returns, long[0], "std", long[1], "_l", panel=panel)
    return df.withColumn(out, -R.ratio("_s", F.nullif(F.col("_l"), F.lit(0.0)))).drop("_s", "_l")


def industry_momentum(df: DataFrame, returns: str, industry: str, n: int, out: str, panel: Panel = PANEL) -> DataFrame:
    """The relative change over n dates of the industry's mean return itself, not of a price."""
    means = df.groupBy(panel.date, industry).agg(F.avg(returns).alias("_mean"))
    moved = means.withColumn(out, R.pct_change("_mean", R.by(industry).orderBy(panel.date), n)).drop("_mean")
    return df.join(moved, [panel.date, industry], "left")


def hermite_stability(df: DataFrame, activity: str, n: int = 60, least: int = 36, bound: float = 8.0, out: str = "hermite_stability", panel: Panel = PANEL) -> DataFrame:
    """Minus the log of the energy of rolling means of the third and fourth Hermite polynomials of a z-score."""

    def means(x: np.ndarray, *of) -> list[np.ndarray]:
        """Of the known values of each window of n: their means, and those of functions of them and the mean."""
        rows = np.lib.stride_tricks.sliding_window_view(np.concatenate([np.full(n - 1, np.nan), x]), n)
        there = ~np.isnan(rows)
        count = there.sum(1)
        some = np.maximum(count, 1)
        base = rows[np.arange(len(rows)), there.argmax(1)]  # equal values leave exactly nothing
        off = np.where(there, rows - base[:, None], 0.0)
        mean = off.sum(1) / some
        out = [base + mean, *(np.where(there, f(off - mean[:, None]), 0.0).sum(1) / some for f in of)]
        return [np.where(count >= least, v, np.nan) for v in out]

    def compute(x: np.ndarray) -> np.ndarray:
        if not len(x):
            return x
        mean, variance = means(x, np.square)
        with np.errstate(divide="ignore", invalid="ignore"):
            z = np.clip(np.where(variance > 0, (x - mean) / np.sqrt(variance), np.nan), -bound, bound)
        (m3,), (m4,) = means(z * z * z - 3 * z), means(z * z * z * z - 6 * z * z + 3)
        return -np.log1p(m3 * m3 / 6 + m4 * m4 / 24)

    found = _per_entity(df.select(*panel.keys, *(c for c in df.columns if c not in panel.keys)), activity, out, compute, panel)
    return found.select(*df.columns, F.nanvl(out, F.lit(None).cast("double")).alias(out))


def true_range(high: str, low: str, close: str, panel: Panel = PANEL) -> Column:
    before = F.lag(close).over(panel.history())
    return F.greatest(F.col(high) - F.col(low), F.abs(F.col(high) - before), F.abs(F.col(low) - before))


def average_true_range(df: DataFrame, n: int = 14, out: str = "atr", panel: Panel = PANEL) -> DataFrame:
    return roll(df.withColumn("true_range", true_range("high", "low", "close", panel)), "true_range", n, "mean", n, out, panel=panel)


def rolling_high(df: DataFrame, n: int = 20, high: str = "high", exclude_current: bool = True, out: str = "rolling_high", panel: Panel = PANEL) -> DataFrame:
    w = panel.last(n, -1 if exclude_current else 0)
    return df.withColumn(out, R.rolling(F.max(high), w, high, n))


def volume_weighted_cost(df: DataFrame, n: int, price: str, volume: str, out: str, least: int | None = None, panel: Panel = PANEL) -> DataFrame:
    w = panel.last(n)
    value = F.col(price) * F.col(volume)
    total = F.sum(volume).over(w)
    return df.withColumn(out, F.when((F.count(value).over(w) >= (least or n)) & (total > 0), F.sum(value).over(w) / total))


def volume_ratio(df: DataFrame, volume: str, n: int = 20, least: int = 5, out: str = "volume_ratio", panel: Panel = PANEL) -> DataFrame:
    """Volume over the mean of the n rows before."""
    w = panel.last(n, -1)
    return df.withColumn(out, R.ratio(volume, F.nullif(R.rolling(F.avg(volume), w, volume, least), F.lit(0.0))))


def moving_averages(df: DataFrame, close: str, volume: str, windows: Sequence[int], panel: Panel = PANEL) -> DataFrame:
    """Moving averages, their change, volume over its own, n-row returns, and realised volatility."""
    h = panel.history()
    for n in windows:
        df = roll(df, close, n, "mean", n, f"sma_{n}", panel=panel)
        df = df.withColumn(f"sma_{n}_change", R.pct_change(f"sma_{n}", h))
        df = roll(df, volume, n, "mean", n, "_v", panel=panel).withColumn(f"volume_sma_{n}_ratio", R.ratio(volume, F.nullif(F.col("_v"), F.lit(0.0)))).drop("_v")
        df = df.withColumn(f"ret_{n}", R.pct_change(close, h, n)).withColumn("_r", R.pct_change(close, h))
        df = roll(df, "_r", n, "std0", n, f"rv_{n}", panel=panel).drop("_r")
    return df


def rolling_cusum(df: DataFrame, value: str, n: int, threshold: float, panel: Panel = PANEL) -> DataFrame:
    """Rolling sums of the positive and the negative part of a rolling z-score, and whether either passes the threshold."""
    w = panel.last(n)
    spread = R.rolling(F.stddev_pop(value), w, value, n)
    df = df.withColumn("_z", F.when(spread > 0, (F.col(value) - R.rolling(F.avg(value), w, value, n)) / spread))
    up, down = F.sum(F.when(F.col("_z").isNotNull(), F.greatest("_z", F.lit(0.0)))).over(w), F.sum(F.when(F.col("_z").isNotNull(), F.least("_z", F.lit(0.0)))).over(w)
    enough = F.count("_z").over(w) >= n
    df = df.withColumn("cusum_up", F.when(enough, up)).withColumn("cusum_down", F.when(enough, down)).drop("_z")
    return df.withColumn("cusum_break", F.coalesce(F.greatest("cusum_up", -F.col("cusum_down")) >= threshold * math.sqrt(n), F.lit(False)))


def downside_rms(df: DataFrame, returns: str, n: int, out: str, panel: Panel = PANEL) -> DataFrame:
    """The downside root mean square over exactly n dates of the calendar, NULL if one is missing."""
    source, w = on_positions(df, n, panel)
    square = F.when(F.col(returns).isNotNull(), F.pow(F.least(F.col(returns), F.lit(0.0)), F.lit(2.0)))
    value = F.when(F.count(square).over(w) == n, F.sqrt(F.avg(square).over(w)))
    return source.withColumn(out, value).select(*df.columns, out)


def _per_entity(df: DataFrame, column: str, out: str, compute, panel: Panel) -> DataFrame:
    """A recurrence along an entity's history, in the order of dates: one entity is one group."""

    def apply(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(panel.date)
        return group.assign(**{out: compute(group[column].to_numpy(float))})

    schema = df.withColumn(out, F.lit(None).cast("double")).schema
    return df.groupBy(panel.entity).applyInPandas(apply, schema)


def exponential_mean(x: np.ndarray, alpha: float, first: int) -> np.ndarray:
    """y = alpha * x + (1 - alpha) * y before, begun with the mean of the first ``first`` values."""
    out = np.full(len(x), np.nan)
    if len(x) >= first:
        out[first - 1] = x[:first].mean()
        for k in range(first, len(x)):
            out[k] = alpha * x[k] + (1 - alpha) * out[k - 1]
    return out


def rsi(df: DataFrame, close: str, n: int = 14, out: str = "rsi", panel: Panel = PANEL) -> DataFrame:
    """Wilder's relative strength index; NULL until n changes are known."""

    def compute(x: np.ndarray) -> np.ndarray:
        change = np.diff(x)
        up, down = (exponential_mean(np.maximum(s * change, 0), 1 / n, n) for s in (1, -1))
        with np.errstate(all="ignore"):
            value = 100 * up / (up + down)
        return np.concatenate([[np.nan], value])[: len(x)]

    found = _per_entity(df, close, out, compute, panel)
    return found.withColumn(out, F.nanvl(out, F.lit(None).cast("double")))


def macd(df: DataFrame, close: str, fast: int = 12, slow: int = 26, signal: int = 9, out: str = "macd_hist", panel: Panel = PANEL) -> DataFrame:
    """The histogram of the difference of two exponential means and its own."""

    def compute(x: np.ndarray) -> np.ndarray:
        line = exponential_mean(x, 2 / (fast + 1), fast) - exponential_mean(x, 2 / (slow + 1), slow)
        known = line[~np.isnan(line)]
        mean = exponential_mean(known, 2 / (signal + 1), signal)
        return np.concatenate([np.full(len(x) - len(known), np.nan), known - mean])

    found = _per_entity(df, close, out, compute, panel)
    return found.withColumn(out, F.nanvl(out, F.lit(None).cast("double")))


def ewm_volatility(df: DataFrame, close: str, span: int = 100, out: str = "target", panel: Panel = PANEL) -> DataFrame:
    """The exponentially weighted sample deviation of returns."""

    def compute(x: np.ndarray) -> np.ndarray:
        return pd.Series(x).pct_change(fill_method=None).ewm(span=span, adjust=False).std().to_numpy()

    found = _per_entity(df, close, out, compute, panel)
    return found.withColumn(out, F.nanvl(out, F.lit(None).cast("double")))


def fracdiff_weights(d: float, threshold: float = 1e-5, most: int = 10_000) -> np.ndarray:
    """The binomial weights of (1 - L)^d, oldest first, cut where they fall below the threshold."""
    w = [1.0]
    while len(w) < most and abs(nxt := -w[-1] * (d - len(w) + 1) / len(w)) >= threshold:
        w.append(nxt)
    return np.array(w[::-1])


def fractional_difference(df: DataFrame, column: str, d: float, threshold: float = 1e-5, out: str = "fracdiff", panel: Panel = PANEL) -> DataFrame:
    """The fixed-width fractional difference; NULL where one of the values in its width is missing."""
    w = fracdiff_weights(d, threshold)

    def compute(x: np.ndarray) -> np.ndarray:
        value = np.full(len(x), np.nan)
        if len(x) >= len(w):
            value[len(w) - 1 :] = np.lib.stride_tricks.sliding_window_view(x, len(w)) @ w
        return value

    found = _per_entity(df, column, out, compute, panel)
    return found.withColumn(out, F.nanvl(out, F.lit(None).cast("double")))


def adf_t(x: np.ndarray, lags: int = 1) -> float:
    """The t statistic of the level in the regression of changes on level, lagged changes and a constant."""
    x = x[~np.isnan(x)]
    dx = np.diff(x)
    n = len(dx) - lags
    if n <= lags + 2:
        return math.nan
    columns = [x[lags:-1], np.ones(n), *(dx[lags - k : len(dx) - k] for k in range(1, lags + 1))]
    a, y = np.column_stack(columns), dx[lags:]
    beta, *_ = np.linalg.lstsq(a, y, rcond=None)
    left = y - a @ beta
    variance = left @ left / (n - a.shape[1]) * np.linalg.pinv(a.T @ a)[0, 0]
    return float(beta[0] / math.sqrt(variance)) if variance > 0 else math.nan


def stationarity(df: DataFrame, column: str, lags: int = 1, least_window: int | None = None, panel: Panel = PANEL) -> DataFrame:
    """entity, n, adf_t: one row for each entity; with a least window also sadf, the greatest over later beginnings."""

    def compute(group: pd.DataFrame) -> pd.DataFrame:
        x = group.sort_values(panel.date)[column].to_numpy(float)
        sup = max((adf_t(x[k:], lags) for k in range(0, len(x) - least_window + 1)), default=math.nan) if least_window and len(x) >= least_window else math.nan
        return pd.DataFrame({panel.entity: group[panel.entity].iloc[:1], "n": [len(x)], "adf_t": [adf_t(x, lags)], "sadf": [sup]})

    kind = df.schema[panel.entity].dataType.simpleString()
    found = df.select(panel.entity, panel.date, column).groupBy(panel.entity).applyInPandas(compute, f"{panel.entity} {kind}, n long, adf_t double, sadf double")
    return found.withColumns({c: F.nanvl(c, F.lit(None).cast("double")) for c in ("adf_t", "sadf")})


def adf_t_by_start(x: np.ndarray, least_window: int, lags: int = 1) -> np.ndarray:
    """``adf_t`` of x[k:] for each k that leaves a least window; x has no missing values."""
    found = [t[0] for t in _adf_t_of_ends(x, least_window, lags, max(len(x), least_window))]
    return found[0] if found else np.full(0, math.nan)


def _adf_t_of_ends(x: np.ndarray, least_window: int, lags: int, first: int):
    """``adf_t`` of x[k:end] for ends from ``first`` on, some ends at a time: arrays of ends by beginnings k.

    Sums of products from each beginning on go from end to end, so that no regression adds up its rows again. The
    constant and the lagged changes are eliminated from them for all beginnings and ends of an array at once; what is
    nearly singular or leaves nearly nothing is done one by one.
    """
    if first > len(x):
        return
    width, dx = lags + 2, np.diff(x)
    rows = [np.ones(max(0, len(dx) - lags)), *(dx[lags - k : len(dx) - k] for k in range(1, lags + 1)), x[lags:-1] - x.mean(), dx[lags:]]
    at = [(i, j) for i in range(width + 1) for j in range(max(1, i), width + 1)]
    products = np.array([rows[i] * rows[j] for i, j in at]) if len(dx) > lags else np.zeros((len(at), 0))
    most = max(1, min(16, least_window - lags - 1))  # more ends at a time would reach beyond the sums of the latest beginnings
    sums = np.zeros((len(at), len(x)))  # by beginning, of the rows before the next one
    done = max(0, first - 2 - lags)
    sums[:, :done] = np.cumsum(products[:, :done][:, ::-1], axis=1)[:, ::-1]
    for end in range(first, len(x) + 1, most):
        ends = np.arange(end, min(end + most, len(x) + 1))
        starts, fresh = int(ends[-1]) - least_window + 1, products[:, done : max(0, int(ends[-1]) - 1 - lags)]
        added = np.cumsum(fresh, axis=1) if fresh.shape[1] == len(ends) else np.zeros((len(at), len(ends)))
        g = dict(zip(at, sums[:, None, :starts] + added[:, :, None]))
        n = ends[:, None] - 1 - lags - np.arange(starts)[None, :]
        asked = (np.arange(starts)[None, :] <= ends[:, None] - least_window) & (n > lags + 2)
        g[0, 0] = n.astype(float)
        whole = [g[k, k] for k in range(width + 1)]
        with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
            for k in range(width - 1):
                share = {j: g[k, j] / g[k, k] for j in range(k + 1, width + 1)}
                for i in range(k + 1, width + 1):
                    for j in range(i, width + 1):
                        g[i, j] = g[i, j] - share[i] * g[k, j]
            level, both = g[width - 1, width - 1], g[width - 1, width]
            left = g[width, width] - both * both / level
            varied = level / np.maximum(whole[width - 1], 1e-300)
            for k in range(1, width - 1):
                varied = varied * (g[k, k] / np.maximum(whole[k], 1e-300))
            t = both / np.sqrt(left / (n - width) * level)
            sound = (varied > 1e-7) & (level > 0) & (left > 1e-7 * whole[width])
        t = np.where(asked & sound, t, math.nan)
        for e, k in np.argwhere(asked & ~sound).tolist():
            t[e, k] = adf_t(x[k : int(ends[e])], lags)
        yield t
        sums[:, :done] += added[:, -1:]
        sums[:, done : done + fresh.shape[1]] = np.cumsum(fresh[:, ::-1], axis=1)[:, ::-1]
        done += fresh.shape[1]


def sup_adf(df: DataFrame, column: str, least_window: int, lags: int = 1, block: int = 1024, panel: Panel = PANEL) -> DataFrame:
    """entity, date, sadf: for each end date from the least window on, the greatest ADF t over all beginnings.

    Missing values are left out before. A task has a block of an entity's end dates, and its history up to them.
    NULL where no beginning has a t.
    """
    known = df.select(panel.entity, panel.date, column).filter(F.col(column).isNotNull() & ~F.isnan(column))
    known = known.withColumns({"_n": F.row_number().over(panel.history()), "_all": F.count(F.lit(1)).over(Window.partitionBy(panel.entity))})
    blocks = F.sequence(F.floor((F.col("_n") - 1) / block), F.floor((F.col("_all") - 1) / block))
    spread = known.withColumn("_block", F.explode(blocks)).drop("_all")

    def compute(group: pd.DataFrame) -> pd.DataFrame:
        x, order = group[column].to_numpy(float), np.argsort(group["_n"].to_numpy())
        x, first = x[order], max(int(group["_block"].iloc[0]) * block + 1, least_window)
        values = [np.where(np.isnan(t), -np.inf, t).max(axis=1) for t in _adf_t_of_ends(x, least_window, lags, first)]
        sadf, at = np.concatenate([np.zeros(0), *values]), order[first - 1 :]
        return pd.DataFrame({panel.entity: group[panel.entity].to_numpy()[at], panel.date: group[panel.date].to_numpy()[at], "sadf": np.where(sadf == -np.inf, math.nan, sadf)})

    types = {c: df.schema[c].dataType.simpleString() for c in (panel.entity, panel.date)}
    found = spread.groupBy(panel.entity, "_block").applyInPandas(compute, f"{panel.entity} {types[panel.entity]}, {panel.date} {types[panel.date]}, sadf double")
    return found.withColumn("sadf", F.nanvl("sadf", F.lit(None).cast("double")))


def symmetric_cusum(df: DataFrame, column: str, threshold: float | str, drift: float = 0.0, panel: Panel = PANEL) -> DataFrame:
    """entity, date, direction, statistic: where a sum of the column's values, upwards or downwards, passes the limit.

    threshold: a number, or the column of each row's limit. The sum that passes starts again and the other goes on; if
    both pass, the upward one does. Rows without a value or a limit are passed over.
    """
    limit = F.col(threshold) if isinstance(threshold, str) else F.lit(float(threshold))

    def compute(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(panel.date)
        up = down = 0.0
        found = []
        for date, value, most in zip(group[panel.date], group[column].to_numpy(float), group["_limit"].to_numpy(float)):
            if not math.isfinite(value) or not math.isfinite(most):
                continue
            up, down = max(0.0, up + value - drift), min(0.0, down + value + drift)
            if up > most:
                found.append((date, 1, up))
                up = 0.0
            elif -down > most:
                found.append((date, -1, down))
                down = 0.0
        return pd.DataFrame({panel.entity: group[panel.entity].iloc[0], panel.date: [f[0] for f in found], "direction": [f[1] for f in found], "statistic": [f[2] for f in found]})

    types = {c: df.schema[c].dataType.simpleString() for c in (panel.entity, panel.date)}
    schema = f"{panel.entity} {types[panel.entity]}, {panel.date} {types[panel.date]}, direction int, statistic double"
    return df.select(panel.entity, panel.date, column, limit.alias("_limit")).groupBy(panel.entity).applyInPandas(compute, schema)


def recursive_residuals(df: DataFrame, y: str, x: str, least: int = 20, panel: Panel = PANEL) -> DataFrame:
    """date, entity, recursive_residual, cusum, standardized_cusum: each y against what the rows before it foretell.

    The regression on x and a constant is of the entity's earlier rows alone, ``least`` of them and x varied; the
    error is divided by the root of one plus the row's leverage. Rows without x or y are left out; rows without a
    forecast have NULLs.
    """
    known = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*panel.keys, y, x)
    before = panel.history().rowsBetween(Window.unboundedPreceding, -1)
    n, mean_x, mean_y, spread = (f(c).over(before) for f, c in ((F.count, x), (F.avg, x), (F.avg, y), (F.var_pop, x)))
    sums = known.withColumns({"_n": n, "_mx": mean_x, "_my": mean_y, "_v": F.nullif(spread, F.lit(0.0)), "_c": F.covar_pop(x, y).over(before)})
    off = F.col(x) - F.col("_mx")
    error = F.col(y) - F.col("_my") - R.ratio("_c", "_v") * off
    leverage = R.ratio(F.lit(1.0), "_n") + R.ratio(off * off, F.col("_v") * F.col("_n"))
    found = sums.withColumn("recursive_residual", F.when(F.col("_n") >= least, error / F.sqrt(1 + leverage)))
    so_far = panel.history().rowsBetween(Window.unboundedPreceding, 0)
    total = F.when(F.col("recursive_residual").isNotNull(), F.sum("recursive_residual").over(so_far))
    scale = F.nullif(F.stddev_samp("recursive_residual").over(R.by(panel.entity)), F.lit(0.0))
    return found.withColumns({"cusum": total, "standardized_cusum": R.ratio(total, scale)}).select(*panel.keys, "recursive_residual", "cusum", "standardized_cusum")


def break_summary(df: DataFrame, statistic: str, threshold: float, panel: Panel = PANEL) -> DataFrame:
    """entity, observations, break_count, maximum, latest of a statistic of breaks; NULLs do not count."""
    known = F.col(statistic).isNotNull()
    return df.groupBy(panel.entity).agg(
        F.count(statistic).alias("observations"),
        F.count(F.when(F.col(statistic) >= threshold, 1)).alias("break_count"),
        F.max(statistic).alias("maximum"),
        F.max_by(statistic, F.when(known, F.col(panel.date))).alias("latest"),
    )
