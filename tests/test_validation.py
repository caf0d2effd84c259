"""Cross-validation and calibration against plain versions of their definitions."""

import datetime
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspark.operators import calibration, cpcv

DAY = datetime.date(2024, 1, 1)


def day(k):
    return DAY + datetime.timedelta(days=k)


def plain_roles(dates, plan):
    """Each split's dates by every pair of windows."""
    days = sorted(dates)
    size, more = divmod(len(days), plan.n)
    cuts = [g * size + min(g, more) for g in range(plan.n + 1)]
    group = {d: g for g in range(plan.n) for d in days[cuts[g] : cuts[g + 1]]}
    out = {}
    for split, chosen in enumerate(itertools.combinations(range(plan.n), plan.k), 1):
        test = [d for d in days if group[d] in chosen]
        windows = [dates[d] for d in test]
        known = all(w is not None for w in windows)
        places = [days.index(d) for d in test]
        for d in days:
            role, own = "train", dates[d]
            if d in test:
                role = "test"
            elif not known:
                if plan.gap and min(places) - plan.gap <= days.index(d) <= max(places) + plan.gap:
                    role = "purged"
            elif own is None or any(own[0] <= b and a <= own[1] for a, b in windows):
                role = "purged"
            elif plan.embargo_days and any(b < d <= b + datetime.timedelta(days=plan.embargo_days) for _, b in windows):
                role = "embargoed"
            out[split, d] = role, "event_window" if known else "fallback_gap" if plan.gap else "none"
    return out


@pytest.mark.parametrize(("seed", "missing", "embargo", "gap"), [(1, 0.0, 0, 0), (2, 0.0, 4, 0), (3, 0.1, 3, 2), (4, 0.1, 0, 0), (5, 0.0, 9, 1)])
def test_roles(spark, seed, missing, embargo, gap):
    r = random.Random(seed)
    dates = {day(k): None if r.random() < missing else (day(k + r.randint(0, 3)), day(k + r.randint(3, 9))) for k in sorted(r.sample(range(60), 31))}
    plan = cpcv.Plan(5, 2, embargo_days=embargo, gap=gap)
    rows = [(d, *(w or (None, None))) for d, w in dates.items()]
    found = cpcv.roles(spark.createDataFrame(rows, "trade_date date, label_start date, label_end date"), plan)
    assert {(x.split_id, x.trade_date): (x.role, x.purge_mode) for x in found.collect()} == plain_roles(dates, plan)
    total = {x.split_id: x for x in cpcv.splits(found, plan).collect()}
    assert all(x.test_dates + x.train_dates + x.purged_dates + x.embargoed_dates == 31 for x in total.values())


def test_paths_are_filled_in_order():
    plan = cpcv.Plan(6, 2)
    chosen = plan.chosen()
    paths = {}
    for path, split in plan.paths(range(1, 16)):
        paths.setdefault(path, []).append(chosen[split - 1])
    assert paths == {1: [(0, 1), (2, 3), (4, 5)], 2: [(0, 2), (1, 3)], 3: [(0, 3), (1, 2)], 4: [(0, 4), (1, 5)], 5: [(0, 5), (1, 4)]}
    assert plan.paths([2, 1]) == [(1, 1), (2, 2)]


@pytest.mark.parametrize(("n", "k"), [(3, 3), (3, 0), (40, 20), (63, 1)])
def test_plans_that_cannot_be(n, k):
    with pytest.raises(ValueError):
        cpcv.Plan(n, k)


def test_too_few_dates(spark):
    rows = spark.createDataFrame([(day(k), day(k), day(k)) for k in range(3)], "trade_date date, label_start date, label_end date")
    with pytest.raises(ValueError):
        cpcv.roles(rows, cpcv.Plan(5, 2))


def test_fits_from_sums_are_fits_of_the_rows(spark):
    r = np.random.default_rng(4)
    rows = [(day(k), str(s), float(a), float(b), None if r.random() < 0.1 else float(2 * a - b + r.normal())) for k in range(24) for s in range(6) for a, b in [r.normal(size=2)]]
    df = spark.createDataFrame(rows, "trade_date date, symbol string, a double, b double, y double")
    plan = cpcv.Plan(4, 2, embargo_days=1)
    found = cpcv.roles(spark.createDataFrame([(day(k), day(k + 1), day(k + 2)) for k in range(24)], "trade_date date, label_start date, label_end date"), plan)
    role = {(x.split_id, x.trade_date): x.role for x in found.collect()}
    fits = {x.split_id: x for x in cpcv.ridge_of_splits(df, found, ["a", "b"], "y", 0.5).collect()}
    assert len(fits) == 6
    for split, fit in fits.items():
        train = [x for x in rows if role[split, x[0]] == "train" and x[4] is not None]
        x, y = np.array([[*t[2:4]] for t in train]), np.array([t[4] for t in train])
        centre = x - x.mean(0)
        b = np.linalg.solve(centre.T @ centre + 0.5 * np.eye(2), centre.T @ (y - y.mean()))
        assert fit.n == len(train)
        assert np.allclose(fit.coefficients, b) and np.isclose(fit.intercept, y.mean() - x.mean(0) @ b)
    out = cpcv.audit(df, spark.createDataFrame([(day(k), day(k + 1), day(k + 2)) for k in range(24)], "trade_date date, label_start date, label_end date"), plan, ["a", "b"], "y", 0.5, quantiles=3).collect()
    assert len(out) == 3 and all(x.ic_mean > 0.3 for x in out)
    paths = cpcv.tested(found, plan)
    scored = cpcv.scores(df, paths, cpcv.ridge_of_splits(df, found, ["a", "b"], "y", 0.5), ["a", "b"], "y")
    assert scored.groupBy("path_id", "trade_date", "symbol").count().filter("count > 1").isEmpty()
    assert scored.count() == 3 * len(rows)  # three paths, each of which tests each date once


def plain_isotonic(n, s):
    """By the greatest least mean of all spans around each value."""
    mean = lambda i, j: sum(s[i : j + 1]) / sum(n[i : j + 1])
    return [max(min(mean(i, j) for j in range(k, len(n))) for i in range(k + 1)) for k in range(len(n))]


@pytest.mark.parametrize("seed", range(5))
def test_isotonic(seed):
    r = np.random.default_rng(seed)
    n = r.integers(1, 6, 25).astype(float)
    s = np.array([r.integers(0, x + 1) for x in n], float)
    assert np.allclose(calibration.isotonic(n, s), plain_isotonic(n.tolist(), s.tolist()))


@pytest.mark.parametrize("seed", range(4))
def test_platt_is_the_least_of_its_loss(seed):
    r = np.random.default_rng(seed)
    x, n = np.sort(r.normal(size=30)), r.integers(1, 9, 30).astype(float)
    s = np.array([r.binomial(int(k), 1 / (1 + np.exp(-(0.3 + 5 * v)))) for k, v in zip(n, x)], float)
    a, b = calibration.platt(x, n, s)
    p = 1 / (1 + np.exp(-(a + b * x)))
    assert abs((s - n * p).sum()) < 1e-6 and abs((x * (s - n * p)).sum() - b) < 1e-6


@pytest.mark.parametrize("method", ["isotonic", "platt"])
@pytest.mark.parametrize("block", [1, 3, 64])
def test_expanding_sees_earlier_dates_alone(spark, method, block):
    r = random.Random(7)
    rows = [(day(k), str(s), None if r.random() < 0.05 else round(r.random(), 2), r.choice([0, 1, 1, None, 2])) for k in range(12) for s in range(15)]
    df = spark.createDataFrame(rows, "trade_date date, symbol string, score double, y int")
    found = {(x.trade_date, x.symbol): x.calibrated for x in calibration.expanding(df, "score", "y", method, digits=2, least=20, block=block).collect()}
    assert len(found) == len(rows)
    for date, symbol, score, _ in rows:
        train = [(x[2], x[3]) for x in rows if x[0] < date and x[2] is not None and x[3] in (0, 1)]
        if score is None or len(train) < 20:
            assert found[date, symbol] is None
            continue
        xs = sorted({x for x, _ in train})
        n, s = [sum(x == v for x, _ in train) for v in xs], [sum(y for x, y in train if x == v) for v in xs]
        if method == "isotonic":
            want = np.interp(score, xs, plain_isotonic(n, s))
        else:
            a, b = calibration.platt(np.array(xs), np.array(n, float), np.array(s, float))
            want = 1 / (1 + np.exp(-(a + b * score)))
        assert found[date, symbol] == pytest.approx(want, abs=1e-9)


def test_no_outcomes(spark):
    df = spark.createDataFrame([(day(0), "a", 0.5, None), (day(1), "a", 0.5, None)], "trade_date date, symbol string, score double, y int")
    assert [x.calibrated for x in calibration.expanding(df, "score", "y").collect()] == [None, None]
    assert calibration.brier(calibration.expanding(df, "score", "y"), "score", "y").first().observations == 0
    with pytest.raises(ValueError):
        calibration.expanding(df, "score", "y", "other")
    assert calibration.expanding(df.filter(F.lit(False)), "score", "y").collect() == []
