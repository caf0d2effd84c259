"""The listwise ranker against its definition."""

import datetime
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspark.operators import ranking

DAY = datetime.date(2024, 1, 1)
FEATURES = ["a", "b"]


def day(k):
    return DAY + datetime.timedelta(days=k)


@pytest.fixture(scope="module")
def rows():
    r = np.random.default_rng(2)
    out = []
    for k in range(10):
        x = r.normal(size=(12, 2)) * [1, 50] + [3, 100]
        score = 2 * x[:, 0] - 0.01 * x[:, 1] + r.normal(size=12)
        pct = (np.argsort(np.argsort(score)) + 1) / 12
        out += [(day(k), f"s{s:02d}", float(x[s, 0]) if s else None, float(x[s, 1]), float(pct[s]) if s != 5 else None, day(k + 2) if s != 6 else None) for s in range(12)]
    return out


@pytest.fixture(scope="module")
def panel(spark, rows):
    return spark.createDataFrame(rows, "trade_date date, symbol string, a double, b double, label double, label_end date")


def plain_loss(rows, w, penalty, means, scales):
    total = penalty * sum(x * x for x in w) / 2
    for d in {x[0] for x in rows}:
        mine = [x for x in rows if x[0] == d]
        g = [round(31 * x[4]) for x in mine]
        s = [sum(u * (0.0 if v is None else (v - m) / c) for u, v, m, c in zip(w, x[2:4], means, scales)) for x in mine]
        log = math.log(sum(map(math.exp, s)))
        total += sum(a / sum(g) * (log - b) for a, b in zip(g, s))
    return total


def test_weights_have_the_least_loss(rows, panel):
    model = ranking.fit_listwise(panel, FEATURES, "label", "label_end", as_of=day(9), train_dates=6, penalty=0.5)
    seen = [x for x in rows if x[4] is not None and x[5] is not None and x[5] <= day(9)]
    days = sorted({x[0] for x in seen})[-6:]
    seen = [x for x in seen if x[0] in days]
    assert (model.rows, model.dates, model.train_start, model.train_end) == (len(seen), 6, day(2), day(7))
    columns = [[x[k] for x in seen if x[k] is not None] for k in (2, 3)]
    assert np.allclose(model.means, [np.mean(c) for c in columns]) and np.allclose(model.scales, [np.std(c) for c in columns])
    at = plain_loss(seen, model.weights, 0.5, model.means, model.scales)
    for k in range(2):
        for e in (1e-3, -1e-3):
            w = list(model.weights)
            w[k] += e
            assert plain_loss(seen, w, 0.5, model.means, model.scales) > at
    slopes = []
    for k in range(2):
        up, down = (list(model.weights) for _ in range(2))
        up[k] += 1e-4
        down[k] -= 1e-4
        slopes.append((plain_loss(seen, up, 0.5, model.means, model.scales) - plain_loss(seen, down, 0.5, model.means, model.scales)) / 2e-4)
    assert np.abs(slopes).max() < 1e-5


def test_order_and_partitions_do_not_matter(panel):
    a, b = (ranking.fit_listwise(df, FEATURES, "label", "label_end") for df in (panel, panel.repartition(5, F.rand(1))))
    assert np.allclose(a.weights, b.weights, atol=1e-9)


def test_predictions_rank_and_contributions_add_up(panel):
    model = ranking.fit_listwise(panel, FEATURES, "label", "label_end", as_of=day(6))
    assert model.weights[0] > 0 > model.weights[1]
    found = model.predict(panel)
    assert found.columns == ["trade_date", "symbol", "percentile", "rank"]
    parts = {(r.trade_date, r.symbol): r.contribution_a + r.contribution_b for r in model.explain(panel).collect()}
    for d in (day(0), day(9)):
        mine = sorted(((r["rank"], r.symbol, r.percentile) for r in found.filter(F.col("trade_date") == F.lit(d)).collect()))
        assert [x[0] for x in mine] == list(range(1, 13))
        assert [x[1] for x in mine] == [s for _, s in sorted((-parts[d, f"s{s:02d}"], f"s{s:02d}") for s in range(12))]
        assert [round(x[2] * 12, 6) for x in mine] == list(range(12, 0, -1))
    scored = panel.join(found, ["trade_date", "symbol"])
    assert scored.filter(F.col("trade_date") > F.lit(day(6))).agg(F.corr("percentile", "label")).first()[0] > 0.5


def test_ndcg(spark):
    rows = [(day(0), "a", 1.0, 2), (day(0), "b", 0.5, 1), (day(0), "c", 0.0, 3), (day(1), "a", 0.0, 1), (day(0), "d", None, 4)]
    df = spark.createDataFrame(rows, "trade_date date, symbol string, label double, rank int")
    gain = [2**31 - 1, 2**16 - 1]  # 15.5 is graded 16, the even one
    want = (gain[1] + gain[0] / math.log2(3)) / (gain[0] + gain[1] / math.log2(3))
    assert {r.trade_date: r.ndcg for r in ranking.ndcg(df, "label").collect()} == {day(0): pytest.approx(want), day(1): None}
    assert {r.trade_date: r.ndcg for r in ranking.ndcg(df, "label", k=1).collect()} == {day(0): pytest.approx(gain[1] / gain[0]), day(1): None}


def test_what_cannot_be_trained_on(panel):
    with pytest.raises(ValueError, match="no labels"):
        ranking.fit_listwise(panel, FEATURES, "label", "label_end", as_of=day(0))
    with pytest.raises(ValueError, match="no labels"):
        ranking.fit_listwise(panel, FEATURES, "label", "label_end", least=13)
    with pytest.raises(ValueError, match="end after"):
        ranking.fit_listwise(panel.withColumn("label_end", F.col("trade_date")), FEATURES, "label", "label_end")
    with pytest.raises(ValueError, match="missing"):
        ranking.fit_listwise(panel, ["nope"], "label", "label_end")
