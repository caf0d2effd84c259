"""Models of cross-sections: linear, ridge, elastic net, forests and boosted trees of pyspark.ml, and calibration."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomspark.functions import recipes as R
from loomspark.operators.panel import PANEL, Panel
from loomspark.operators.splits import Fold

KINDS = {
    "ridge": lambda p: LinearRegression(regParam=p.get("alpha", 1.0), elasticNetParam=0.0, standardization=False),
    "ridge_scaled": lambda p: LinearRegression(regParam=p.get("alpha", 1.0), elasticNetParam=0.0, standardization=True),
    "elasticnet": lambda p: LinearRegression(regParam=p.get("alpha", 1.0), elasticNetParam=p.get("l1_ratio", 0.5)),
    "random_forest": lambda p: RandomForestRegressor(numTrees=p.get("trees", 20), maxDepth=p.get("depth", 5), seed=p.get("seed", 42)),
    "boosted_trees": lambda p: GBTRegressor(maxIter=p.get("trees", 20), maxDepth=p.get("depth", 3), seed=p.get("seed", 42)),
}


def fit(train: DataFrame, features: Sequence[str], target: str, kind: str = "ridge", weight: str | None = None, **parameters) -> PipelineModel:
    """A model of the target; missing features take the train rows' medians."""
    filled = [f"{f}__filled" for f in features]
    learner = KINDS[kind](parameters).setFeaturesCol("features").setLabelCol(target).setPredictionCol("pred")
    if weight:
        learner = learner.setWeightCol(weight)
    stages = [Imputer(strategy="median", inputCols=list(features), outputCols=filled), VectorAssembler(inputCols=filled, outputCol="features"), learner]
    return Pipeline(stages=stages).fit(train.filter(F.col(target).isNotNull()))


def predict(model: PipelineModel, df: DataFrame) -> DataFrame:
    """df with pred."""
    columns = [*df.columns, "pred"]
    return model.transform(df).select(*columns)


def importance(model: PipelineModel, features: Sequence[str]) -> list[tuple[str, float]]:
    last = model.stages[-1]
    values = last.featureImportances if hasattr(last, "featureImportances") else last.coefficients
    return sorted(zip(features, (abs(float(v)) for v in values.toArray())), key=lambda x: (-x[1], x[0]))


def walk(df: DataFrame, folds: Sequence[Fold], features: Sequence[str], target: str, kind: str = "ridge", panel: Panel = PANEL, **parameters) -> DataFrame:
    """Out-of-sample predictions of each fold, with its number. The folds are a loop on the driver, each a job."""
    out = None
    for k, fold in enumerate(folds):
        train, test = (df.filter(F.col(panel.date).isin(list(days))) for days in (fold.train, fold.test))
        scored = predict(fit(train, features, target, kind, **parameters), test).withColumn("fold", F.lit(k))
        out = scored if out is None else out.unionByName(scored)
    return out


def rank_target(df: DataFrame, target: str, out: str = "rank_target", panel: Panel = PANEL) -> DataFrame:
    """The target's percent rank by date, from -0.5 to 0.5, for models that are to rank."""
    return df.withColumn(out, R.percent_rank(target, [panel.date]) - 0.5)


def expanding_calibration(df: DataFrame, score: str, outcome: str, bins: int = 20, least: int = 200, out: str = "calibrated", panel: Panel = PANEL) -> DataFrame:
    """The share of outcomes in the score's bin on strictly earlier dates, once there are enough; scores are from 0 to 1.

    A histogram in place of a fit for each date: counts by date and bin, summed up along the dates.
    """
    binned = df.withColumn("_bin", F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)).cast("int"))
    days = binned.groupBy(panel.date, "_bin").agg(F.count(outcome).alias("n"), F.sum(outcome).alias("s"))
    grid = days.select(panel.date).distinct().select(panel.date, F.explode(F.array(*(F.lit(k) for k in range(bins)))).alias("_bin")).join(days, [panel.date, "_bin"], "left")
    w = R.by("_bin").orderBy(panel.date).rowsBetween(Window.unboundedPreceding, -1)
    summed = grid.withColumn("_n", F.coalesce(F.sum("n").over(w), F.lit(0))).withColumn("_s", F.coalesce(F.sum("s").over(w), F.lit(0)))
    total = summed.withColumn("_all", F.sum("_n").over(R.by(panel.date))).withColumn("_ok", F.sum("_s").over(R.by(panel.date)))
    share = F.when(F.col("_all") >= least, (F.col("_s") + R.ratio("_ok", "_all")) / (F.col("_n") + 1))
    return binned.join(total.select(panel.date, "_bin", share.alias(out)), [panel.date, "_bin"], "left").drop("_bin")
