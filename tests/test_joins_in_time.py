"""Overlays, intervals and inference over dates against plain versions."""

import datetime
import math
import random

import pytest
from pyspark.sql import functions as F

from loomspark.operators import inference, joins, labels

DAY = datetime.date(2024, 1, 1)


def day(k):
    return DAY + datetime.timedelta(days=k)


def test_overlay_takes_each_column_from_its_own_latest_source(spark):
    r = random.Random(4)
    some = lambda: None if r.random() < 0.4 else round(r.random(), 3)
    base = [(day(k), s, some()) for k in range(12) for s in "ab"]
    first = [(s, day(k), some(), some()) for k in range(0, 12, 3) for s in "ab"] + [("a", None, 1.0, 1.0)]
    second = [(s, day(k), some()) for k in range(0, 12, 2) for s in "b"]
    df = spark.createDataFrame(base, "trade_date date, symbol string, x double")
    one = spark.createDataFrame(first, "symbol string, seen date, x double, y double")
    two = spark.createDataFrame(second, "symbol string, visible date, y double")
    out = joins.overlay(df, [("one", one, "seen"), ("two", two, "visible")], ["x", "y"], own="panel").collect()
    assert len(out) == len(base)
    for got in out:
        def latest(rows, at):
            found = [(x[1], x[at]) for x in rows if x[0] == got.symbol and x[1] is not None and x[1] <= got.trade_date and x[at] is not None]
            return max(found) if found else None

        own = next(x[2] for x in base if x[:2] == (got.trade_date, got.symbol))
        want = [("one", latest(first, 2)), ("panel", (got.trade_date, own) if own is not None else None)]
        name, found = next(((n, f) for n, f in want if f), (None, (None, None)))
        assert (got.x, got.x__source, got.x__as_of) == (found[1], name, found[0])
        name, found = next(((n, f) for n, f in [("one", latest(first, 3)), ("two", latest(second, 2))] if f), (None, (None, None)))
        assert (got.y, got.y__source, got.y__as_of) == (found[1], name, found[0])
    replaced = joins.overlay(df, [("one", one, "seen")], ["x"]).filter("symbol = 'b' and x__source is null")
    assert replaced.filter("x is not null").isEmpty()
    with pytest.raises(ValueError):
        joins.overlay(df, [("two", two, "visible")], ["z"])


def test_intervals_that_overlap_and_nest(spark):
    r = random.Random(6)
    rows = [("ab"[r.randint(0, 1)], day(a := r.randint(0, 30)), None if r.random() < 0.2 else day(a + r.randint(0, 15)), f"g{k}") for k in range(25)]
    df = spark.createDataFrame([(day(k), s) for k in range(-2, 50) for s in "abc"], "trade_date date, symbol string")
    out = joins.interval_member(df, spark.createDataFrame(rows, "symbol string, begins date, ends date, grp string"), "begins", "ends", "grp").collect()
    assert len(out) == df.count()
    for x in out:
        held = [(a, g) for s, a, b, g in rows if s == x.symbol and a <= x.trade_date and (b is None or x.trade_date <= b)]
        assert x.grp == (max(held)[1] if held else None)


def test_compounded_between(spark):
    returns = [(day(k), None if k == 4 else 0.01 * k) for k in range(0, 10, 2)]
    periods = [(1, day(0), day(6)), (2, day(3), day(5)), (3, day(-5), day(1)), (4, day(8), day(20)), (5, None, day(4)), (6, day(2), day(8))]
    out = joins.compounded_between(spark.createDataFrame(periods, "id int, a date, b date"), spark.createDataFrame(returns, "d date, r double"), "a", "b", "d", "r", "total")
    for x in out.collect():
        found = [v for d, v in returns if x.a is not None and x.a < d <= x.b and v is not None]
        assert x.total == (pytest.approx(math.prod(1 + v for v in found) - 1) if found else None)


@pytest.mark.parametrize("stat", ["mean", "median", "std0", "positive_ratio"])
def test_trailing_months(spark, stat):
    r = random.Random(2)
    rows = [(datetime.date(2020 + k // 12, k % 12 + 1, 28), s, None if r.random() < 0.2 else r.gauss(0, 1)) for k in range(30) for s in "ab"]
    out = joins.trailing_calendar_stat(spark.createDataFrame(rows, "trade_date date, symbol string, v double"), "v", 7, stat, 3, "out").collect()
    for x in out:
        months = lambda d: d.year * 12 + d.month
        seen = sorted(v for d, s, v in rows if s == x.symbol and v is not None and 0 <= months(x.trade_date) - months(d) <= 7)
        n = len(seen)
        if n < 3:
            assert x.out is None
            continue
        mean = sum(seen) / n
        want = {"mean": mean, "median": (seen[(n - 1) // 2] + seen[n // 2]) / 2, "std0": math.sqrt(sum((v - mean) ** 2 for v in seen) / n), "positive_ratio": sum(v > 0 for v in seen) / n}[stat]
        assert x.out == pytest.approx(want)


@pytest.mark.parametrize("lag", [None, 0, 3, 50])
def test_newey_west_in_one_window(spark, lag):
    r = random.Random(1)
    series = {g: [(day(k), None if r.random() < 0.1 else r.gauss(0.1, 1)) for k in range(n)] for g, n in (("long", 140), ("short", 6), ("one", 1), ("two", 2))}
    df = spark.createDataFrame([(g, *x) for g, xs in series.items() for x in xs], "g string, d date, v double")
    for x in inference.newey_west_of(df, "v", "d", lag, ["g"]).collect():
        want = inference.newey_west([v for _, v in series[x.g]], lag)
        assert x.n == want["n"] and x.mean == pytest.approx(want["mean"])
        if want["n"] < 2:
            assert x.error is None
        else:
            assert x.lag == want["lag"] and x.error == pytest.approx(want["error"])


def test_barriers_by_the_path(spark):
    r = random.Random(9)
    prices = {s: [100.0] for s in "ab"}
    for s in prices:
        for _ in range(40):
            prices[s].append(round(prices[s][-1] * (1 + r.gauss(0, 0.02)), 4))
    df = spark.createDataFrame([(s, day(k), p) for s, ps in prices.items() for k, p in enumerate(ps)], "symbol string, trade_date date, close double")
    events = [(k, "ab"[k % 2], day(k), r.choice([0.01, 0.03, 0.0]), r.choice([1, -1])) for k in range(41)]
    out = labels.triple_barrier(df, spark.createDataFrame(events, "event_id int, symbol string, trade_date date, target double, side int"), 6, 1.0, 1.5)
    got = {x.event_id: (x.barrier, x.touched, x.label) for x in out.collect()}
    want = {}
    for i, s, d, target, side in events:
        k = (d - DAY).days
        for step in range(1, 7):
            if k + step > 40 or target <= 0:
                break
            gain = (prices[s][k + step] / prices[s][k] - 1) * side
            kind = "profit_taking" if gain >= target else "stop_loss" if gain <= -1.5 * target else "vertical" if step == 6 else None
            if kind:
                want[i] = kind, day(k + step), {"profit_taking": 1, "stop_loss": -1}.get(kind, (gain > 0) - (gain < 0))
                break
    assert got == want and len(want) > 20
