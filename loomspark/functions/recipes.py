"""Column recipes with fixed rules for nulls, ties and least observations.

Missing is NULL alone: NaN and infinities become NULL at the sources. Windows of rows are by position and need a
total order. Division by zero is NULL.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

Name = str | Column


def col(x: Name) -> Column:
    return F.col(x) if isinstance(x, str) else x


def clean(x: Name) -> Column:
    """A double, NULL for what is no number, for NaN and for infinities."""
    v = col(x).try_cast("double") if isinstance(x, str) else x.try_cast("double")
    return F.when(F.isnan(v) | (F.abs(v) == F.lit(float("inf"))), None).otherwise(v)


def ratio(a: Name, b: Name) -> Column:
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def clip(x: Name, low: float | Column | None = None, high: float | Column | None = None) -> Column:
    """x held between low and high; NULL stays NULL."""
    v = col(x)
    out = v
    if low is not None:
        out = F.when(v < low, low).otherwise(out)
    if high is not None:
        out = F.when(v > high, high).otherwise(out)
    return F.when(v.isNull(), None).otherwise(out)


def by(*keys: Name) -> WindowSpec:
    return Window.partitionBy(*keys)


def percent_rank(x: Name, group: Sequence[Name]) -> Column:
    """Average rank of ties over the number of values that are not null; NULL for NULL."""
    v = col(x)
    ordered = by(*group).orderBy(v.asc_nulls_last())
    ties = F.count(v).over(by(*group, v))
    rank = F.rank().over(ordered) + (ties - 1) / F.lit(2.0)
    return F.when(v.isNotNull(), rank / F.count(v).over(by(*group)))


def percent_rank_bottom(x: Name, group: Sequence[Name]) -> Column:
    """As percent_rank, with NULLs as one tie above all values and counted."""
    v = col(x)
    ties = F.count(F.lit(1)).over(by(*group, v))
    rank = F.rank().over(by(*group).orderBy(v.asc_nulls_last())) + (ties - 1) / F.lit(2.0)
    return rank / F.count(F.lit(1)).over(by(*group))


def average_rank(x: Name, group: Sequence[Name]) -> Column:
    v = col(x)
    ties = F.count(v).over(by(*group, v))
    return F.when(v.isNotNull(), F.rank().over(by(*group).orderBy(v.asc_nulls_last())) + (ties - 1) / F.lit(2.0))


def first_rank(x: Name, group: Sequence[Name], tie: Sequence[Name], descending: bool = False) -> Column:
    """1, 2 … in order of x and then of the tie-break."""
    v = col(x)
    return F.row_number().over(by(*group).orderBy(v.desc_nulls_last() if descending else v.asc_nulls_last(), *tie))


def bucket_of_rank(rank: Column, n: Column, bins: int) -> Column:
    """The bin, from 0, of a first-rank among n by equal counts."""
    return F.greatest(F.ceil((rank - 1) * F.lit(float(bins)) / (n - 1)).cast("bigint") - 1, F.lit(0).cast("bigint"))


def rows(keys: Sequence[Name], order: Sequence[Name], n: int, until: int = 0) -> WindowSpec:
    return by(*keys).orderBy(*order).rowsBetween(until - n + 1, until)


def rolling(value: Column, window: WindowSpec, of: Name, least: int) -> Column:
    """An aggregate over a window where at least ``least`` values are not null."""
    return F.when(F.count(col(of)).over(window) >= least, value.over(window))


def pct_change(x: Name, ordered: WindowSpec, n: int = 1) -> Column:
    return ratio(x, F.lag(col(x), n).over(ordered)) - 1


def quantile_clip(x: Name, group: Sequence[Name], low: float, high: float) -> Column:
    """x held between two quantiles of its group, by linear interpolation."""
    w = by(*group)
    return clip(x, F.percentile(col(x), low).over(w), F.percentile(col(x), high).over(w))


def zscore(x: Name, group: Sequence[Name], sample: bool = False, zero: float | None = None) -> Column:
    """Standard score in a group; ``zero`` where the deviation is zero or x is NULL, NULL if that is None."""
    w = by(*group)
    spread = (F.stddev_samp if sample else F.stddev_pop)(col(x)).over(w)
    z = F.when(spread > 0, (col(x) - F.avg(col(x)).over(w)) / spread)
    return z if zero is None else F.coalesce(z, F.lit(zero))


def pearson(x: Name, y: Name) -> Column:
    """Correlation over rows where both are there, as an aggregate; NULL where either does not vary."""
    both = col(x).isNotNull() & col(y).isNotNull()
    a, b = F.when(both, col(x)), F.when(both, col(y))
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def skewness(x: Name) -> Column:
    """Bias-corrected; 0 for three or more equal values."""
    n = F.count(col(x)).cast("double")
    return F.when(n >= 3, F.coalesce(F.skewness(col(x)) * F.sqrt(n * (n - 1)) / (n - 2), F.lit(0.0)))


def kurtosis(x: Name) -> Column:
    """Bias-corrected excess; 0 for four or more equal values."""
    n = F.count(col(x)).cast("double")
    return F.when(n >= 4, F.coalesce((n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(col(x)) + 6), F.lit(0.0)))


def compounded(r: Name) -> Column:
    """The total of returns above -1, as an aggregate."""
    return F.exp(F.sum(F.log1p(col(r)))) - 1


def mean_of(columns: Sequence[Column], weights: Sequence[float] | None = None) -> Column:
    """The weighted mean of those that are not null."""
    weights = weights or [1.0] * len(columns)
    total = sum((F.coalesce(c * w, F.lit(0.0)) for c, w in zip(columns, weights)), F.lit(0.0))
    weight = sum((F.when(c.isNotNull(), F.lit(float(w))).otherwise(0.0) for c, w in zip(columns, weights)), F.lit(0.0))
    return F.try_divide(total, weight)


def rolling_median(x: Name, window: WindowSpec) -> Column:
    """The median over a frame, which Spark's own median does not take."""
    s = F.array_sort(F.collect_list(col(x)).over(window))
    n = F.size(s)
    return F.when(n > 0, (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / F.lit(2.0))
