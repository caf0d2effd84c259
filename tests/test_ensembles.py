"""Factor selection, regimes and weights with a memory against plain versions of their definitions."""

import datetime
import random

import numpy as np
import pandas as pd
import pytest

from loomspark.operators import ensembles

DAY = datetime.date(2024, 1, 1)


def day(k):
    return DAY + datetime.timedelta(days=k)


def test_rolling_correlations(spark):
    r = np.random.default_rng(1)
    rows = [(day(k), s, *(None if r.random() < 0.2 else float(x) for x in r.normal(size=3) + [0, s, 5])) for k in range(12) for s in range(5)]
    df = spark.createDataFrame(rows, "trade_date date, symbol int, a double, b double, c double")
    frame = pd.DataFrame(rows, columns=["d", "s", "a", "b", "c"])
    for x in ensembles.rolling_correlations(df, ["c", "a", "b"], 4).collect():
        past = frame[(frame.d < x.trade_date) & (frame.d >= x.trade_date - datetime.timedelta(days=4))][[x.left_factor, x.right_factor]].dropna()
        assert x.n_obs == len(past) and x.left_factor < x.right_factor
        if x.trade_date == day(0):
            assert x["corr"] is None
        else:
            assert x["corr"] == pytest.approx(past.corr().iloc[0, 1], abs=1e-9)


def test_select_factors(spark):
    cases = {  # strength, ic, coverage of each factor; what is chosen, and why not
        day(0): ([("a", 3.0, 1.0, 1.0), ("b", 2.0, 1.0, 1.0), ("c", 1.0, 1.0, 1.0), ("d", 0.5, 0.0, 1.0), ("e", 9.0, None, 1.0), ("f", 9.0, 1.0, 0.0)], {"a": "", "b": "correlation_filtered", "c": "", "d": "ic_low", "e": "insufficient_history", "f": "coverage_low"}),
        day(1): ([("a", 0.1, 0.0, 1.0), ("b", 0.3, 0.0, 1.0), ("c", None, 0.0, 1.0), ("d", 0.3, 0.0, 1.0)], {"b": "", "a": "ic_low", "c": "ic_low", "d": "ic_low"}),
        day(2): ([("b", None, 1.0, 1.0), ("a", 0.01, 1.0, 1.0), ("c", 0.2, 1.0, 1.0)], {"a": "strength_below_threshold", "b": "", "c": ""}),
        day(3): ([("a", None, 0.0, 0.0)], {"a": "ic_low"}),
    }
    rows = [(d, *x) for d, (xs, _) in cases.items() for x in xs]
    diagnostics = spark.createDataFrame(rows, "trade_date date, factor string, strength double, ic double, coverage double")
    correlations = spark.createDataFrame([(day(0), "a", "b", -0.9), (day(0), "b", "c", 0.95), (day(0), "a", "c", 0.5), (day(1), "a", "b", 1.0), (day(2), "b", "c", None)], "trade_date date, left_factor string, right_factor string, corr double")
    out = ensembles.select_factors(diagnostics, correlations, [("ic", "ic_low", 0.5), ("coverage", "coverage_low", 0.5), ("strength", "unused", None)], 0.8, least_strength=0.05)
    got = {}
    for x in out.collect():
        got.setdefault(x.trade_date, {})[x.factor] = x.reason
        assert x.selected == (x.reason == "")
    assert got == {d: want for d, (_, want) in cases.items()}


def plain_regimes(returns, features, days, window):
    """As the definition has it, with pandas."""
    scores = pd.DataFrame(0.0, index=days, columns=sorted({f for _, f in returns}))
    for k, d in enumerate(days):
        if k < window:
            continue
        hist, found = days[k - window : k], []
        for name in sorted({f for _, f in features}):
            past = pd.Series({h: features.get((h, name)) for h in hist}, dtype=float).dropna()
            now = features.get((d, name))
            if len(past) < max(3, window // 3) or now is None:
                continue
            low, high = past.quantile(1 / 3) + 1e-12, past.quantile(2 / 3) - 1e-12  # which may be a little off a value they hit
            chosen = past[past <= low] if now <= low else past[past >= high] if now >= high else past[(past > low) & (past < high)]
            if len(chosen):
                found.append(pd.Series({f: pd.Series([returns.get((h, f)) for h in chosen.index], dtype=float).mean() for f in scores.columns}))
        if found:
            scores.loc[d] = pd.concat(found, axis=1).mean(axis=1)
    spread = scores.std(axis=1, ddof=0).replace(0.0, np.nan)
    return scores.sub(scores.mean(axis=1), axis=0).div(spread, axis=0).fillna(0.0)


def test_regime_scores(spark):
    r = random.Random(3)
    days = [day(2 * k) for k in range(30)]
    returns = {(d, f): None if r.random() < 0.1 else r.gauss(0, 1) for d in days for f in "xyz"}
    features = {(d, f): None if r.random() < 0.2 else round(r.random(), 1) for d in days for f in ("vol", "level", "rare")}
    features |= {(d, "rare"): None for d in days[3:]}
    a = spark.createDataFrame([(*k, v) for k, v in returns.items()], "trade_date date, factor string, value double")
    b = spark.createDataFrame([(*k, v) for k, v in features.items()], "trade_date date, feature string, value double")
    want = plain_regimes(returns, features, days, 9)
    got = ensembles.regime_scores(a, b, 9).collect()
    assert len(got) == 90
    for x in got:
        assert x.regime_score == pytest.approx(want.loc[x.trade_date, x.factor], abs=1e-9)


def plain_budget(targets, most):
    held, out = {}, {}
    for d in sorted(targets):
        names = {*held, *targets[d]}
        turnover = sum(abs(targets[d].get(e, 0) - held.get(e, 0)) for e in names)
        new = dict(targets[d])
        if held and most < 2 and turnover > most:
            new = {e: max(0, held.get(e, 0) + (targets[d].get(e, 0) - held.get(e, 0)) * most / turnover) for e in names}
            new = {e: w / sum(new.values()) for e, w in new.items()}
        held = {e: w for e, w in new.items() if w >= 1e-12}
        out[d] = held, turnover
    return out


@pytest.mark.parametrize(("block", "most"), [(3, 0.3), (100, 0.3), (4, 2.0)])
def test_turnover_budget(spark, block, most):
    r = random.Random(5)
    rows, targets = [], {}
    for g in ("p", "q"):
        for k in range(14):
            w = [r.random() for _ in range(3)]
            for e, x in zip(r.sample("abcdef", 3), w):
                rows.append((g, day(k), e, x / sum(w)))
                targets.setdefault(g, {}).setdefault(day(k), {})[e] = x / sum(w)
    df = spark.createDataFrame(rows, "book string, trade_date date, symbol string, target double").repartition(3)
    got = {}
    for x in ensembles.turnover_budget(df, "target", most, ["book"], block=block).collect():
        got.setdefault((x.book, x.trade_date), {})[x.symbol] = x.weight, x.turnover
    want = {(g, d): {e: (pytest.approx(w), pytest.approx(t)) for e, w in held.items()} for g in targets for d, (held, t) in plain_budget(targets[g], most).items()}
    assert got == want


@pytest.mark.parametrize("block", [1, 4, 512])
def test_holdings_go_on_from_block_to_block(spark, block):
    r = random.Random(8)
    rows = [(day(k), s, r.random()) for k in range(11) for s in range(8)]
    df = spark.createDataFrame(rows, "trade_date date, symbol int, score double")
    got, held = {}, set()
    for x in ensembles.held_with_buffer(df, "score", 3, 5, block=block).collect():
        got.setdefault(x.trade_date, {})[x.symbol] = x["rank"], x.kept
    for k in range(11):
        best = [s for _, s in sorted((-v, s) for d, s, v in rows if d == day(k))][:5]
        stay = [s for s in best if s in held][:3]
        new = [s for s in best if s not in held][: 3 - len(stay)]
        assert got[day(k)] == {s: (best.index(s) + 1, s in stay) for s in [*stay, *new]}
        held = {*stay, *new}


def test_nothing_to_hold(spark):
    none = spark.createDataFrame([], "trade_date date, symbol string, target double")
    assert ensembles.turnover_budget(none, "target", 0.3).collect() == []
    assert ensembles.held_with_buffer(none, "target", 2, 3).collect() == []
