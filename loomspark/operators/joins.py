"""Joins in time: as of a date, within an interval, by the calendar, and over overlapping periods."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomspark.functions import recipes as R
from loomspark.operators.panel import PANEL, Panel, calendar, keep_one, require

#: Bytes of a right side that is broadcast in an as-of join without keys.
SMALL = 32 << 20


def as_of(left: DataFrame, right: DataFrame, on: str, right_on: str, by: Sequence[str], columns: Sequence[str], tie: Sequence[str] = ()) -> DataFrame:
    """Each left row with the last right row of its key at or before it, whole, even where its values are NULL.

    Both sides are put into one history per key and read once; of right rows at one time the last by ``tie`` counts.
    """
    row = F.struct(F.col(right_on).alias(f"{right_on}_matched"), *columns)
    order = F.struct(*(F.col(t) for t in tie)) if tie else F.lit(0)
    events = right.filter(F.col(right_on).isNotNull()).select(*by, F.col(right_on).alias("_t"), F.lit(0).alias("_side"), order.alias("_o"), row.alias("_r"), F.lit(None).cast(left.select(F.struct("*")).schema[0].dataType).alias("_l"))
    asks = left.select(*by, F.col(on).alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast(events.schema["_o"].dataType).alias("_o"), F.lit(None).cast(events.schema["_r"].dataType).alias("_r"), F.struct("*").alias("_l"))
    w = Window.partitionBy(*by).orderBy(F.col("_t").asc_nulls_first(), "_side", "_o").rowsBetween(Window.unboundedPreceding, 0)
    found = events.unionByName(asks).withColumn("_last", F.last("_r", ignorenulls=True).over(w)).filter("_side = 1")
    return found.select("_l.*", "_last.*")


def context_as_of(panel_frame: DataFrame, context: DataFrame, features: Sequence[str], age_limits: dict[str, int] | None = None, panel: Panel = PANEL) -> DataFrame:
    """Each feature's value as last seen by each date, with its age in days; too old ones become NULL.

    context: feature, visible (date), value, and period_end, from which ages count. There is no key: only distinct
    dates are looked up, against a context that holds few rows a feature.
    """
    dates = panel_frame.select(panel.date).distinct()
    for name in features:
        own = context.filter(F.col("feature") == name).groupBy("visible").agg(F.max(F.struct("period_end", "value")).alias("_v"))
        pairs = dates.withColumn("_k", F.lit(0)).select(panel.date, "_k")
        seen = as_of(pairs, own.withColumn("_k", F.lit(0)), panel.date, "visible", ["_k"], ["_v"])
        age = F.datediff(panel.date, F.col("_v.period_end"))
        limit = (age_limits or {}).get(name)
        value = F.when(age <= limit, F.col("_v.value")) if limit is not None else F.col("_v.value")
        panel_frame = panel_frame.join(F.broadcast(seen.select(panel.date, value.alias(name), age.alias(f"{name}__age_days"))), panel.date, "left")
    return panel_frame


def interval_member(df: DataFrame, members: DataFrame, start: str, end: str, value: str, panel: Panel = PANEL) -> DataFrame:
    """The value of the interval that holds each date; of several that which began last, and of those the greatest; an
    open end holds for ever.

    Intervals alone are cut where any of their entity begins or has ended, and each row looks up the last cut before it.
    """
    until = F.date_add(F.coalesce(F.col(end), F.lit("9999-12-30").cast("date")), 1)
    own = members.filter(F.col(start).isNotNull() & (F.col(start) < until)).select(panel.entity, F.col(start).alias("_a"), until.alias("_b"), F.col(value).alias("_v"))
    cuts = own.select(panel.entity, F.explode(F.array("_a", "_b")).alias("_cut")).distinct()
    holds = cuts.join(own, panel.entity, "left").filter((F.col("_cut") >= F.col("_a")) & (F.col("_cut") < F.col("_b")))
    latest = holds.groupBy(panel.entity, "_cut").agg(F.max_by("_v", F.struct("_a", "_v")).alias(value))
    return as_of(df, cuts.join(latest, [panel.entity, "_cut"], "left"), panel.date, "_cut", [panel.entity], [value]).drop("_cut_matched")


def universe_as_of(df: DataFrame, universe: DataFrame, rebalance: str, panel: Panel = PANEL) -> DataFrame:
    """Rows of entities that belong to the universe of the last rebalance date at or before each date."""
    every = universe.select(F.col(rebalance).alias("_d")).distinct().withColumn("_k", F.lit(0))
    dates = df.select(panel.date).distinct().withColumn("_k", F.lit(0))
    of = as_of(dates, every, panel.date, "_d", ["_k"], []).select(panel.date, F.col("_d_matched").alias(rebalance)).filter(F.col(rebalance).isNotNull())
    return df.join(F.broadcast(of), panel.date).join(universe.select(rebalance, panel.entity).distinct(), [rebalance, panel.entity], "left_semi")


def future_date(df: DataFrame, offset: int, out: str, panel: Panel = PANEL) -> DataFrame:
    """The date ``offset`` places later in the calendar."""
    days = calendar(df, panel)
    moved = days.select((F.col("position") - offset).alias("position"), F.col(panel.date).alias(out))
    return df.join(F.broadcast(days.join(moved, "position", "left").drop("position")), panel.date, "left")


def lookup(df: DataFrame, value: str, at: str, out: str, panel: Panel = PANEL) -> DataFrame:
    """The entity's value on the date in column ``at``."""
    other = df.select(F.col(panel.entity), F.col(panel.date).alias(at), F.col(value).alias(out))
    return df.join(other, [panel.entity, at], "left")


def lagged_features(df: DataFrame, features: DataFrame, columns: Sequence[str], lag: int, panel: Panel = PANEL) -> DataFrame:
    """Features of ``lag`` dates earlier, joined one to one, and whether there are any."""
    right = features.select(*panel.keys, *columns)
    if lag:
        right = right.withColumnRenamed(panel.date, "_from")
        days = calendar(df, panel)
        moved = days.select((F.col("position") + lag).alias("position"), F.col(panel.date).alias("_from")).join(days, "position").drop("position")
        right = right.join(F.broadcast(moved), "_from").drop("_from")
    return df.join(right.withColumn("features_available", F.lit(True)), panel.keys, "left").withColumn("features_available", F.coalesce("features_available", F.lit(False)))


def period_target(df: DataFrame, entity: str, period: str, available: str, value: str, months: int, kind: str = "level") -> DataFrame:
    """The value of the period ``months`` later: level, delta or pct_change; not if it was available before the features."""
    later = df.select(F.col(entity), F.add_months(period, -months).alias(period), F.col(value).alias("_v"), F.col(available).alias("label_end"))
    joined = df.join(later, [entity, period], "left")
    known = F.col("label_end") > F.col(available)
    change = {"level": F.col("_v"), "delta": F.col("_v") - F.col(value), "pct_change": R.ratio(F.col("_v") - F.col(value), F.abs(F.nullif(F.col(value), F.lit(0.0))))}[kind]
    return joined.withColumn("target", F.when(known, change)).withColumn("label_end", F.when(known, F.col("label_end"))).drop("_v")


def compounded_between(periods: DataFrame, returns: DataFrame, start: str, end: str, date: str, value: str, out: str) -> DataFrame:
    """Each period's compounded return of the dates after its start up to its end; NULL where no return is known there.

    returns: a row a date, added up along the dates once; a period is the difference of two of those sums.
    """
    w = Window.orderBy(date).rowsBetween(Window.unboundedPreceding, 0)  # a row a date
    known = F.col(value).isNotNull()
    sums = returns.groupBy(date).agg(F.sum(F.log1p(value)).alias("_x"), F.count(F.when(known, 1)).alias("_c"))
    sums = sums.select(F.lit(0).alias("_k"), F.col(date).alias("_d"), F.coalesce(F.sum("_x").over(w), F.lit(0.0)).alias("_x"), F.sum("_c").over(w).alias("_c"))
    asked = periods.select(F.explode(F.array(F.col(start).cast("date"), F.col(end).cast("date"))).alias("_at")).distinct().filter("_at is not null").withColumn("_k", F.lit(0))
    found = as_of(asked, sums, "_at", "_d", ["_k"], ["_x", "_c"]).select("_at", F.coalesce("_x", F.lit(0.0)).alias("_x"), F.coalesce("_c", F.lit(0)).alias("_c"))  # a row a date
    for side, column in (("a", start), ("b", end)):
        one = found.select(F.col("_at").alias(f"_at_{side}"), F.col("_x").alias(f"_x_{side}"), F.col("_c").alias(f"_c_{side}"))
        periods = periods.join(one, F.col(column).cast("date") == F.col(f"_at_{side}"), "left").drop(f"_at_{side}")
    total = F.when(F.col("_c_b") > F.col("_c_a"), F.exp(F.col("_x_b") - F.col("_x_a")) - 1)
    return periods.withColumn(out, total).drop("_x_a", "_x_b", "_c_a", "_c_b")


def purge(df: DataFrame, test_start, test_end, embargo_days: int, start: str, end: str) -> DataFrame:
    """Rows whose label period does not overlap a test period and does not begin in the embargo after it."""
    a, b = F.lit(test_start).cast("date"), F.lit(test_end).cast("date")
    overlap = (F.col(start) <= b) & (F.col(end) >= a)
    embargo = (F.col(start) > b) & (F.col(start) <= F.date_add(b, embargo_days))
    return df.filter(~F.coalesce(overlap, F.lit(False)) & ~F.coalesce(embargo, F.lit(False)))


def latest_vintages(df: DataFrame, as_of_date, entity: str, period: str, available: str) -> DataFrame:
    """The latest version of each report that was available by a date."""
    return keep_one(df.filter(F.col(available) <= F.lit(as_of_date).cast("date")), [entity, period], [F.col(available).desc()])


def trailing_calendar_stat(df: DataFrame, value: str, months: int, stat: str, least: int, out: str, panel: Panel = PANEL) -> DataFrame:
    """Of the entity's values in the calendar months up to each date: mean, median, std0 or positive_ratio."""
    over = f"over (partition by `{panel.entity}` order by `{panel.date}` range between interval '{int(months)}' month preceding and current row)"
    of = {
        "mean": f"avg(`{value}`) {over}",
        "median": f"sort_array(collect_list(`{value}`) {over})",
        "std0": f"stddev_pop(`{value}`) {over}",
        "positive_ratio": f"avg(cast(`{value}` > 0 as double)) {over}",
    }[stat]
    found = df.withColumn("_of", F.expr(of)).withColumn("_n", F.expr(f"count(`{value}`) {over}"))
    x = F.col("_of")
    if stat == "median":
        middle = lambda k: F.get(x, F.floor((F.size(x) - 1 + k) / 2).cast("int"))
        x = (middle(0) + middle(1)) / 2
    return found.withColumn(out, F.when(F.col("_n") >= least, x)).drop("_of", "_n")


def calendar_growth(df: DataFrame, value: str, months: int, out: str, panel: Panel = PANEL) -> DataFrame:
    """Yearly growth from the last known value at or before the date ``months`` earlier, by the days between them."""
    known = df.filter(F.col(value).isNotNull()).select(panel.entity, F.col(panel.date).alias("_then"), F.col(value).alias("_old"))
    asked = df.withColumn("_ask", F.add_months(panel.date, -months))
    joined = as_of(asked, known, "_ask", "_then", [panel.entity], ["_old"])
    years = F.datediff(panel.date, "_then_matched") / F.lit(365.25)
    growth = F.when((F.col(value) > 0) & (F.col("_old") > 0) & (years > 0), F.pow(F.col(value) / F.col("_old"), 1 / years) - 1)
    return joined.withColumn(out, growth).drop("_ask", "_then_matched", "_old")


def overlay(df: DataFrame, sources: Sequence[tuple[str, DataFrame, str]], columns: Sequence[str], own: str | None = None, panel: Panel = PANEL) -> DataFrame:
    """df with each of ``columns`` from the first source that knows it, and where from, as <column>__source and
    <column>__as_of.

    sources: (name, table, date column) in order of precedence; a table has the entity, the date from which a row is
    visible, and any of the columns. Each column of a source is its own latest known value at or before the row's date,
    whatever its other columns know. own: the name of df itself as the last source, if it has the columns; without one
    its columns of these names are replaced. What no source knows is NULL, as is where from.
    """
    mine = [c for c in columns if own and c in df.columns]
    out = df.withColumnsRenamed({c: f"_own_{c}" for c in columns if c in df.columns})
    for k, (_, table, visible) in enumerate(sources):
        there = [c for c in columns if c in table.columns]
        require(table, [panel.entity, visible])
        if not there:
            continue
        row = lambda c: F.struct(F.col("_at").alias("at"), F.col(c).alias("value"))
        seen = table.filter(F.col(visible).isNotNull()).select(panel.entity, F.col(visible).cast("date").alias("_at"), *there).groupBy(panel.entity, "_at").agg(*(F.max(c).alias(c) for c in there))
        h = Window.partitionBy(panel.entity).orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
        seen = seen.select(panel.entity, "_at", *(F.last(F.when(F.col(c).isNotNull(), row(c)), ignorenulls=True).over(h).alias(f"_s{k}_{c}") for c in there))
        out = as_of(out, seen, panel.date, "_at", [panel.entity], [f"_s{k}_{c}" for c in there]).drop("_at_matched")
    for c in columns:
        found = [F.struct(F.col(f"_s{k}_{c}.value").alias("value"), F.lit(name).alias("source"), F.col(f"_s{k}_{c}.at").alias("at")) for k, (name, table, _) in enumerate(sources) if c in table.columns]
        known = [F.when(x["value"].isNotNull(), x) for x in found]
        if c in mine:
            known.append(F.when(F.col(f"_own_{c}").isNotNull(), F.struct(F.col(f"_own_{c}").alias("value"), F.lit(own).alias("source"), F.col(panel.date).cast("date").alias("at"))))
        if not known:
            raise ValueError(f"no source has {c}")
        out = out.withColumn("_best", F.coalesce(*known)).withColumns({c: F.col("_best.value"), f"{c}__source": F.col("_best.source"), f"{c}__as_of": F.col("_best.at")})
    helpers = ["_best", *(f"_own_{c}" for c in columns), *(f"_s{k}_{c}" for k in range(len(sources)) for c in columns)]
    return out.drop(*helpers)
