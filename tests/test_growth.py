"""Work and memory that must not grow faster than the tables."""

import math
import time

import numpy as np
from pyspark.sql import functions as F

from loomspark.operators import controls
from loomspark.operators import diagnostics as dg
from loomspark.operators import time_series as ts
from loomspark.plans import diagnostic_queries, registry


def test_sup_adf_adds_up_no_row_again_for_each_end():
    """All windows of 2000 rows, two million regressions; sums made anew for each end took 3 seconds."""
    x = 1000 + np.random.default_rng(1).normal(size=2000).cumsum()
    begin = time.process_time()
    found = np.concatenate([np.nanmax(t, axis=1) for t in ts._adf_t_of_ends(x, 40, 1, 40)])
    assert time.process_time() - begin < 1.5
    for end in (40, 41, 55, 56, 57, 300):
        want = max(ts.adf_t(x[k:end]) for k in range(end - 39))
        assert math.isclose(found[end - 40], want, rel_tol=1e-6)


def test_dates_are_dealt_to_tasks_by_the_number_of_lines(spark):
    """A task of ranks by date has whole dates, and not more lines the larger the table is."""
    d = "/root/testdata/sf0.1"
    for df in (registry.panel(spark, d), diagnostic_queries.forward(spark, d)):
        placed = df.withColumn("task", F.spark_partition_id())
        tasks = placed.groupBy("trade_date").agg(F.countDistinct("task").alias("n"), F.min("task").alias("task"), F.sum("n_lines").alias("lines"))
        per_task = tasks.groupBy("task").agg(F.max("n").alias("n"), F.sum("lines").alias("lines")).collect()
        assert max(r.n for r in per_task) == 1
        assert max(r.lines for r in per_task) < 2 * registry.LINES_OF_TASK


def test_bucket_of_values_counts_different_values_without_nulls(spark):
    rows = [(k, "a", v) for k, v in enumerate([1.0, 1.0, 2.0, None])] + [(k, "b", v) for k, v in enumerate([1.0, 2.0, 3.0])] + [(0, "c", None)]
    df = spark.createDataFrame(rows, "symbol int, trade_date string, v double")
    found = dg.quantile_bucket(df.filter("trade_date <> 'c'"), "v", 3)
    assert "collect_set" not in found._jdf.queryExecution().toString()
    assert sorted((r.trade_date, r.symbol, r.bucket) for r in found.collect() if r.bucket is not None) == [("b", 0, 0), ("b", 1, 1), ("b", 2, 2)]


def test_permutations_rank_once_and_move_rows_once(spark):
    """Whatever the runs, rows go to their date once; before, each run ranked and joined all rows again."""
    df = spark.range(200).selectExpr("id % 20 as symbol", "id div 20 as trade_date", "rand(1) as x", "rand(2) as y")
    plan = controls.permuted_ic(df, "x", "y", 3)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 2
