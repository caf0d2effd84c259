"""The panel that operators work on: one row for each entity and date."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspark.functions import recipes as R


@dataclass(frozen=True)
class Panel:
    """Which columns are the entity and the date."""

    entity: str = "symbol"
    date: str = "trade_date"

    @property
    def keys(self) -> list[str]:
        return [self.date, self.entity]

    def history(self):
        return Window.partitionBy(self.entity).orderBy(self.date)

    def last(self, n: int, until: int = 0):
        return R.rows([self.entity], [self.date], n, until)


PANEL = Panel()


@dataclass(frozen=True)
class Schema:
    """Named roles of a dataset's columns."""

    date: str = "trade_date"
    instrument: str = "symbol"
    price: str | None = None
    label: str | None = None
    tradable: str | None = None
    features: Sequence[str] = field(default_factory=tuple)
    extras: Sequence[str] = field(default_factory=tuple)

    def columns(self) -> list[str]:
        roles = [self.date, self.instrument, self.price, self.label, self.tradable, *self.features, *self.extras]
        return list(dict.fromkeys(c for c in roles if c))


def require(df: DataFrame, columns: Sequence[str]) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")


def dataset(df: DataFrame, schema: Schema) -> DataFrame:
    """The schema's columns in order, dates as DATE, without rows that have no date."""
    require(df, schema.columns())
    return df.select(*schema.columns()).withColumn(schema.date, F.to_date(schema.date)).filter(F.col(schema.date).isNotNull())


def assert_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """df itself; raises if keys repeat. One aggregation runs."""
    if not df.groupBy(*keys).count().filter("count > 1").isEmpty():
        raise ValueError(f"keys {list(keys)} repeat")
    return df


def keep_one(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The first row of each key in the given order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_nth", F.row_number().over(w)).filter("_nth = 1").drop("_nth")


def resolve_symbol(columns: Sequence[str]) -> Column:
    """The first of the columns that is not empty, trimmed."""
    return F.coalesce(*(F.nullif(F.trim(F.col(c).cast("string")), F.lit("")) for c in columns))


def known_false(x: str) -> Column:
    """Whether a dirty flag says no; unknown is not no."""
    text = F.lower(F.trim(F.col(x).cast("string")))
    return F.coalesce(text.try_cast("double") == 0, F.lit(False)) | F.coalesce(text.isin("false", "f", "no", "n"), F.lit(False))


def away_from_limit(price: str, limit: str, side: str) -> Column:
    """Whether a price is inside its limit by more than the tolerance; an unknown one is not."""
    slack = F.greatest(F.abs(F.col(limit)) * 1e-8, F.lit(1e-8))
    inside = F.col(price) < F.col(limit) - slack if side == "buy" else F.col(price) > F.col(limit) + slack
    return F.coalesce(inside, F.lit(False))


def fill_missing(df: DataFrame, features: Sequence[str], method: str, indicators: bool = False, panel: Panel = PANEL) -> DataFrame:
    """Missing features filled by zero or the date's median; indicators of what was missing before."""
    added = {f"{f}_missing": F.col(f).isNull().cast("tinyint") for f in features} if indicators else {}
    if method == "none":
        return df.withColumns(added)
    fill = {f: F.coalesce(f, F.lit(0.0) if method == "zero" else F.median(f).over(R.by(panel.date))) for f in features}
    return df.withColumns(added).withColumns(fill)


def on_dates(df: DataFrame, dates: DataFrame, panel: Panel = PANEL) -> DataFrame:
    """Rows on the given dates."""
    return df.join(F.broadcast(dates.select(panel.date).distinct()), panel.date, "left_semi")


def period_ends(df: DataFrame, frequency: str, panel: Panel = PANEL) -> DataFrame:
    """The last date of each period that the panel has: D, M, Q, or W-MON … W-SUN."""
    d = F.col(panel.date)
    if frequency == "D":
        period = d
    elif frequency.startswith("W-"):
        period = F.next_day(F.date_sub(d, 1), frequency[2:])
    else:
        period = F.trunc(d, {"M": "month", "Q": "quarter"}[frequency])
    return df.groupBy(period.alias("period")).agg(F.max(d).alias(panel.date)).select(panel.date)


def calendar(df: DataFrame, panel: Panel = PANEL) -> DataFrame:
    """Each date with its position and the dates around it. As many rows as dates, so that one ordered window is small."""
    dates = df.select(panel.date).distinct()
    return dates.withColumn("position", F.row_number().over(Window.orderBy(panel.date)).cast("bigint"))


def dense_grid(df: DataFrame, columns: Sequence[str], panel: Panel = PANEL) -> DataFrame:
    """A row for each date of the calendar from an entity's first to its last, NULL where it had none."""
    positions = calendar(df, panel)
    placed = df.select(panel.entity, panel.date, *columns).join(F.broadcast(positions), panel.date)
    spans = placed.groupBy(panel.entity).agg(F.min("position").alias("a"), F.max("position").alias("b"))
    slots = spans.select(panel.entity, F.explode(F.sequence("a", "b")).alias("position"))
    return slots.join(F.broadcast(positions), "position").join(df.select(panel.entity, panel.date, *columns), panel.keys, "left")
