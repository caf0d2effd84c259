import math
from datetime import date, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from loomspark.functions import recipes as R
from loomspark.operators import cross_section as cs
from loomspark.operators import diagnostics as dg
from loomspark.operators import inference as inf
from loomspark.operators import controls, intraday, labels, models, ensembles, selection, splits, weights
from loomspark.operators import panel as pn
from loomspark.operators import time_series as ts
from loomspark.sources import artifacts
from loomspark.streaming import bars as stream_bars

DAYS = [date(2024, 1, 1) + timedelta(days=k) for k in range(80)]


@pytest.fixture(scope="module")
def walk(spark):
    r = np.random.default_rng(1)
    rows = []
    for s in range(4):
        price = 100.0
        for d in DAYS:
            price *= 1 + r.normal(0, 0.02)
            rows.append((s, d, round(price, 4), float(r.integers(1, 50)), None if r.random() < 0.2 else round(float(r.normal()), 4)))
    return spark.createDataFrame(rows, "symbol long, trade_date date, close double, volume double, x double").cache()


def frame(df):
    return df.toPandas().sort_values(["symbol", "trade_date"]).reset_index(drop=True)


def by_symbol(pdf, column, f):
    return pdf.groupby("symbol")[column].transform(f).to_numpy()


def same(a, b):
    np.testing.assert_allclose(np.asarray(a, float), np.asarray(b, float), rtol=1e-9, atol=1e-9)


def test_ranks_and_rolling_are_those_of_pandas(walk):
    p = frame(walk.withColumn("r", R.percent_rank("x", ["trade_date"])).withColumn("b", R.percent_rank_bottom("x", ["trade_date"])))
    same(p["r"], p.groupby("trade_date")["x"].rank(pct=True))
    same(p["b"], p.groupby("trade_date")["x"].rank(pct=True, na_option="bottom"))
    for op in ("mean", "sum", "std", "min", "max", "median"):
        q = frame(ts.roll(walk, "x", 10, op, 4, "y"))
        same(q["y"], by_symbol(q, "x", lambda s: getattr(s.rolling(10, min_periods=4), op)()))  # noqa: B023


def test_moments(spark):
    v = [1.0, 2.0, 2.5, 7.0, -3.0, 0.5]
    df = spark.createDataFrame([(x,) for x in v], "x double")
    got = df.agg(R.skewness("x").alias("s"), R.kurtosis("x").alias("k"), R.compounded(F.col("x") / 100).alias("c")).first()
    s = pd.Series(v)
    same([got.s, got.k, got.c], [s.skew(), s.kurt(), (1 + s / 100).prod() - 1])
    flat = spark.createDataFrame([(1.0,)] * 5, "x double").agg(R.skewness("x").alias("s"), R.kurtosis("x").alias("k"), R.pearson("x", "x").alias("c")).first()
    assert (flat.s, flat.k, flat.c) == (0.0, 0.0, None)


def test_clean_numbers(spark):
    df = spark.createDataFrame([("1.5",), ("x",), ("NaN",), ("Infinity",), (None,)], "v string")
    assert [r[0] for r in df.select(R.clean("v")).collect()] == [1.5, None, None, None, None]


def test_recurrences(walk):
    p = frame(ts.ewm_volatility(walk, "close", 20))
    same(p["target"], by_symbol(p, "close", lambda s: s.pct_change().ewm(span=20, adjust=False).std()))
    p = frame(ts.rsi(walk, "close", 14))
    for _, g in p.groupby("symbol"):
        change = g["close"].diff().to_numpy()[1:]
        up, down = np.maximum(change, 0)[:14].mean(), np.maximum(-change, 0)[:14].mean()
        assert math.isclose(g["rsi"].iloc[14], 100 * up / (up + down))
        assert g["rsi"].iloc[:14].isna().all()
        up, down = up + (max(change[14], 0) - up) / 14, down + (max(-change[14], 0) - down) / 14
        assert math.isclose(g["rsi"].iloc[15], 100 * up / (up + down))
    p = frame(ts.macd(walk, "close"))
    assert p.groupby("symbol")["macd_hist"].apply(lambda s: s.first_valid_index() - s.index[0]).eq(33).all()


def test_fractional_difference(walk):
    w = ts.fracdiff_weights(1.0)
    same(w, [-1, 1])
    p = frame(ts.fractional_difference(walk, "close", 1.0))
    same(p["fracdiff"].dropna(), p.groupby("symbol")["close"].diff().dropna())


def test_stationarity():
    r = np.random.default_rng(0)
    noise = r.normal(size=400)
    assert ts.adf_t(noise) < -8 < ts.adf_t(np.cumsum(noise))


def test_cusum_starts_again(spark):
    """The sum that passes starts again, strictly beyond the limit; the other goes on; limits may vary."""
    values, limits = [1.0, 1.0, 1.0, -1.0, None, -1.0, -0.5, 3.0], [1.5, 1.5, 1.5, 1.5, 1.5, 2.0, 2.0, None]
    df = spark.createDataFrame([(1, d, v, m) for d, v, m in zip(DAYS, values, limits)], "symbol long, trade_date date, v double, m double")
    found = lambda limit: [(r.trade_date, r.direction, r.statistic) for r in ts.symmetric_cusum(df, "v", limit).collect()]
    assert found(1.5) == [(DAYS[1], 1, 2.0), (DAYS[5], -1, -2.0), (DAYS[7], 1, 3.0)]
    assert found("m") == [(DAYS[1], 1, 2.0), (DAYS[6], -1, -2.5)]
    assert found(2.0) == [(DAYS[2], 1, 3.0), (DAYS[6], -1, -2.5), (DAYS[7], 1, 3.0)]


def test_neutralising_by_several_controls(walk):
    p = frame(cs.neutralize(walk, "close", ["volume"], out="n", least=3))
    q = frame(cs.neutralize(walk.withColumn("zero", F.lit(0.0)), "close", ["volume", "zero"], out="n", least=3))
    same(p["n"], q["n"])


def test_peak_measures(spark):
    def one(rows):
        return intraday.peak_measures(spark.createDataFrame([(1, DAYS[0], *r) for r in rows], "symbol long, trade_date date, bar_index long, open double, close double, volume double")).first()

    flat = one([(k, 100.0, 100.0, 5.0) for k in range(1, 5)])
    assert (flat.volume_cv, flat.log_volume_sd, flat.volume_diff, flat.peaks_1, flat.rv, flat.bipower) == (0, 0, 0, 0, 0, 0)
    peaks = one([(k, 100.0, 100.0, v) for k, v in enumerate([1.0, 1.0, 10.0, 10.0, 1.0, 1.0], 118)])
    assert (peaks.peaks_1, peaks.peaks_2) == (1, 0)
    jump = one([(1, 100.0, 101.0, 1.0), (2, 101.0, 101.0, 1.0), (3, 101.0, 101.0, 1.0)])
    assert math.isclose(jump.rv, math.log(1.01) ** 2) and jump.jump_share == 1 and jump.rv_down == 0
    gap = one([(1, 100.0, 101.0, 1.0), (3, 101.0, 102.0, 1.0), (4, 102.0, 103.0, 1.0)])
    assert gap.n_bars == 3 and math.isclose(gap.rv, math.log(1.01) ** 2 + math.log(103 / 102) ** 2)
    twice = one([(1, 100.0, 101.0, 1.0), (1, 100.0, 101.0, 1.0)])
    assert (twice.n_duplicates, twice.rv, twice.volume_cv) == (1, None, None)


def test_barriers(spark):
    prices = spark.createDataFrame([(1, d, p) for d, p in zip(DAYS, [100.0, 101.0, 103.0, 102.0, 99.0, 100.0])], "symbol long, trade_date date, close double")
    events = spark.createDataFrame([(1, 1, DAYS[0], 0.02, 1), (2, 1, DAYS[2], 0.02, 1), (3, 1, DAYS[0], 0.5, 1), (4, 1, DAYS[5], 0.02, 1)], "event_id long, symbol long, trade_date date, target double, side int")
    got = {r.event_id: (r.barrier, r.label) for r in labels.triple_barrier(prices, events, 2, 1.0, 1.0).collect()}
    assert got == {1: ("profit_taking", 1), 2: ("stop_loss", -1), 3: ("vertical", 1)}


def test_buffer_remembers(spark):
    rows = [(s, d, float(v)) for d, day in zip(DAYS, [[5, 4, 3, 2], [1, 4, 3, 5], [1, 2, 3, 5]]) for s, v in enumerate(day)]
    df = spark.createDataFrame(rows, "symbol long, trade_date date, score double")
    got = {}
    for r in ensembles.held_with_buffer(df, "score", 2, 3).collect():
        got.setdefault(r.trade_date, set()).add(r.symbol)
    assert got == {DAYS[0]: {0, 1}, DAYS[1]: {1, 3}, DAYS[2]: {1, 3}}


def test_capped_weights():
    w = selection.capped_weights(np.array([10.0, 1, 1, 1]), 0.4)
    assert math.isclose(w.sum(), 1) and w.max() <= 0.4 + 1e-9


@pytest.mark.parametrize("weights, most, want", [([5, 1, 1], 0.2, [1 / 3] * 3), ([5, 1, 0], 0.4, [0.4, 0.4, 0.2]), ([1, 0], 0.4, [0.5, 0.5]), ([3, 1], 1.5, [0.75, 0.25]), ([0, -1], 0.4, [np.nan] * 2), ([6, 3, 1], 0.5, [0.5, 0.375, 0.125])])
def test_caps_that_few_can_hold(weights, most, want):
    assert np.allclose(selection.capped_weights(np.array(weights, float), most), want, equal_nan=True)


def test_inference():
    x = [0.1, -0.2, 0.3, 0.05, -0.1]
    found = inf.newey_west(x, lag=0)
    assert math.isclose(found["error"], np.std(x) / math.sqrt(5))
    assert inf.holm([0.01, 0.04, 0.03]) == [0.03, 0.06, 0.06]
    assert inf.deflated_sharpe(0.2, 250, 1, 0.01) > inf.deflated_sharpe(0.2, 250, 50, 0.01)


def test_overfitting_probability(spark):
    rows = [(d, c, (0.02 if c == "good" else -0.01) + 0.001 * ((k * 7 + len(c)) % 5)) for k, d in enumerate(DAYS) for c in ("good", "bad", "worse")]
    sums = inf.group_sums(spark.createDataFrame(rows, "d date, c string, r double"), "d", "c", "r", 4).collect()
    found = inf.overfitting_probability([tuple(r) for r in sums], 4)
    assert found["splits"] == 6 and found["pbo"] == 0


def test_folds():
    folds = splits.walk_forward(DAYS, 10, 3, gap=2)
    assert [f.test[-1] for f in folds] == [DAYS[59], DAYS[69], DAYS[79]] and all(f.train[-1] == f.test[0] - timedelta(days=3) for f in folds)
    ends = {d: d + timedelta(days=3) for d in DAYS}
    every = splits.combinatorial(DAYS, 5, 2, ends, 4)
    assert len(every) == 10 and splits.path_count(5, 2) == 4
    for f in every:
        tests = set(f.test)
        assert not any(d + timedelta(days=k) in tests for d in f.train for k in range(4))
    assert splits.train_window([date(2020, 2, 29), date(2021, 2, 28), date(2021, 3, 1)], "rolling", 1, "years") == [date(2021, 2, 28), date(2021, 3, 1)]


def test_models(walk):
    df = walk.filter("x is not null").withColumn("y", F.col("x") * 2 + F.col("volume") * 0.1)
    model = models.fit(df, ["x", "volume"], "y", "ridge", alpha=0.0)
    assert models.predict(model, df).agg(F.max(F.abs(F.col("y") - F.col("pred")))).first()[0] < 1e-6
    assert [f for f, _ in models.importance(model, ["x", "volume"])] == ["x", "volume"]
    with pytest.raises(KeyError):
        models.fit(df, ["x"], "y", "unknown")


def test_uniqueness(spark):
    bars = spark.createDataFrame([("a", d) for d in DAYS[:5]], "g string, bar date")
    events = spark.createDataFrame([("a", DAYS[0], DAYS[1]), ("a", DAYS[1], DAYS[2]), ("a", DAYS[4], DAYS[4])], "g string, s date, e date")
    got = sorted((r.s, r.n_bars, round(r.uniqueness, 6)) for r in weights.average_uniqueness(events, bars, "s", "e", "g").collect())
    assert got == [(DAYS[0], 2, 0.75), (DAYS[1], 2, 0.75), (DAYS[4], 1, 1.0)]


def test_clusters():
    assert dg.clusters([("a", "b", 0.9), ("b", "c", -0.8), ("d", "a", 0.1)], 0.7) == [["a", "b", "c"], ["d"]]


def test_schema_and_keys(walk, spark):
    assert pn.dataset(walk, pn.Schema(price="close", features=["x"])).columns == ["trade_date", "symbol", "close", "x"]
    with pytest.raises(ValueError, match="missing"):
        pn.dataset(walk, pn.Schema(price="nothing"))
    with pytest.raises(ValueError, match="repeat"):
        pn.assert_unique(walk.union(walk), ["symbol", "trade_date"])


def test_artifacts(walk, spark, tmp_path):
    found = artifacts.signals(walk, "x", "m1", "f1", "run")
    about = artifacts.write_signals(found, f"{tmp_path}/s.parquet", {"a": 1})
    again = artifacts.read_signals(spark, f"{tmp_path}/s.parquet")
    assert artifacts.fingerprint(again.repartition(5)) == about["content"] == artifacts.read_metadata(spark, f"{tmp_path}/s.parquet")["content"]
    assert artifacts.violations(found.union(found)) == ["320 keys repeat"]
    assert artifacts.violations(found.drop("rank"))
    dates = spark.createDataFrame([("20240131",), ("20240131.0",), ("2024-01-31",), ("x",)], "d string")
    assert [r[0] for r in dates.select(artifacts.as_date("d")).collect()] == [date(2024, 1, 31)] * 3 + [None]
    for kind in ("csv", "json", "parquet"):
        getattr(walk.limit(3).write.option("header", True), kind)(f"{tmp_path}/t.{'jsonl' if kind == 'json' else kind}")
        assert artifacts.load(spark, f"{tmp_path}/t.{'jsonl' if kind == 'json' else kind}").count() == 3


def test_bars_of_a_stream(spark, tmp_path):
    ticks = spark.sql("select timestamp '2024-01-01 10:00:00' + make_interval(0, 0, 0, 0, 0, 0, id * 60) as ts, id % 2 as symbol, cast(id as double) as price, 1.0 as volume from range(30)")
    ticks.write.parquet(f"{tmp_path}/in")
    stream = stream_bars.bars(spark.readStream.schema(ticks.schema).parquet(f"{tmp_path}/in"))
    job = stream.writeStream.format("memory").queryName("bars_out").outputMode("complete").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    job.awaitTermination(120)
    assert sorted(map(tuple, spark.table("bars_out").collect())) == sorted(map(tuple, stream_bars.bars(ticks).collect()))


def test_overfitting_splits_agree_with_the_list(spark):
    rows = [(d, c, math.sin(k * (3 + len(c))) / 10 + (0.01 if c == "good" else 0.0)) for k, d in enumerate(DAYS) for c in ("good", "bad", "worse", "flat-")]
    sums = inf.group_sums(spark.createDataFrame(rows, "d date, candidate string, r double"), "d", "candidate", "r", 6)
    want = inf.overfitting_probability([tuple(r) for r in sums.collect()], 6)
    got = inf.overfitting_splits(sums, 6).collect()
    assert len(got) == want["splits"] == 20
    assert math.isclose(sum(r.logit <= 0 for r in got) / 20, want["pbo"]) and math.isclose(sum(r.logit for r in got) / 20, want["mean_logit"], abs_tol=1e-9)


def test_recursive_residuals_by_least_squares(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=30)
    y = 2 * x + 1 + rng.normal(size=30)
    rows = [("a", d, float(y[k]) if k != 5 else None, float(x[k])) for k, d in enumerate(DAYS[:30])] + [("b", d, 1.0, 2.0) for d in DAYS[:30]]
    df = ts.recursive_residuals(spark.createDataFrame(rows, "symbol string, trade_date date, y double, x double"), "y", "x", 10)
    got = {s: [r.recursive_residual for r in sorted(df.filter(F.col("symbol") == s).collect(), key=lambda r: r.trade_date)] for s in "ab"}
    assert got["b"] == [None] * 30
    a, b = np.column_stack([np.ones(29), np.delete(x, 5)]), np.delete(y, 5)
    for k in range(29):
        if k < 10:
            assert got["a"][k] is None
        else:
            beta = np.linalg.lstsq(a[:k], b[:k], rcond=None)[0]
            assert math.isclose(got["a"][k], (b[k] - a[k] @ beta) / math.sqrt(1 + a[k] @ np.linalg.inv(a[:k].T @ a[:k]) @ a[k]), rel_tol=1e-6)
    summary = {r.symbol: r for r in ts.break_summary(df, "cusum", 0.0).collect()}
    assert summary["a"].observations == 19 and math.isclose(summary["a"].latest, sum(v for v in got["a"] if v is not None), rel_tol=1e-9)
    assert (summary["b"].observations, summary["b"].break_count, summary["b"].latest) == (0, 0, None)


def test_draws_do_not_depend_on_order(spark, walk):
    a, b = (sorted(map(tuple, controls.random_feature(df, 3).collect()), key=repr) for df in (walk, walk.repartition(5, F.rand(1))))
    assert a == b
    draws = [r[0] for r in spark.range(2000).select(controls.draw(1, "id")).collect()]
    assert 0 <= min(draws) and max(draws) < 1 and abs(np.mean(draws) - 0.5) < 0.03 and len(set(draws)) == 2000


def test_permutations_keep_each_dates_targets(spark):
    rows = [(d, s, float(s), float(s)) for d in DAYS[:10] for s in range(8)] + [(DAYS[0], 99, None, 1.0)]
    df = spark.createDataFrame(rows, "trade_date date, symbol long, x double, y double")
    runs = {r.run: r for r in controls.permuted_ic(df, "x", "y", 19).collect()}
    assert math.isclose(runs[0].mean_ic, 1) and len(runs) == 20 and all(r.n_dates == 10 and r.mean_ic < 0.9 for k, r in runs.items() if k)
    found = controls.permutation_test(controls.permuted_ic(df, "x", "y", 19)).first()
    assert found.runs == 19 and math.isclose(found.p_value, 0.05)


def test_bootstrapped_paths(spark):
    series = spark.createDataFrame([(d, 0.01 * (k % 7 - 2)) for k, d in enumerate(DAYS)] + [(date(2030, 1, 1), None)], "d date, r double")
    got = controls.block_bootstrap(series, "r", "d", 50, 5).collect()
    assert len(got) == 50 and all(r.n == len(DAYS) and -1 < r.max_drawdown <= 0 for r in got) and len({r.total_return for r in got}) > 40
    same = controls.block_bootstrap(series.filter("r = 0.02"), "r", "d", 3, 5).collect()
    assert all(r.sharpe is None or r.sharpe > 1e6 for r in same) and all(r.max_drawdown == 0 for r in same)
    assert controls.block_bootstrap(series.filter("false"), "r", "d").collect() == []


def test_sup_adf_by_a_double_loop(walk):
    got = frame(ts.sup_adf(walk.withColumn("v", F.when(F.dayofmonth("trade_date") != 3, F.col("close"))), "v", 20, block=7))
    want = {}
    for s, g in walk.toPandas().sort_values("trade_date").groupby("symbol"):
        g = g[[d.day != 3 for d in g["trade_date"]]].dropna(subset="close")
        x = g["close"].to_numpy(float)
        for end in range(20, len(x) + 1):
            t = [v for k in range(end - 19) if not math.isnan(v := ts.adf_t(x[k:end]))]
            want[s, g["trade_date"].iloc[end - 1]] = max(t)
    assert {(r.symbol, r.trade_date): r.sadf for r in got.itertuples()} == pytest.approx(want) and want
