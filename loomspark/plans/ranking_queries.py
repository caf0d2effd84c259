"""Queries of the listwise ranker."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from loomspark.functions import recipes as R
from loomspark.operators import ranking
from loomspark.operators.panel import PANEL
from loomspark.plans.diagnostic_queries import forward
from loomspark.plans.registry import query, rounded

AS_OF = datetime.date(1996, 12, 31)
FEATURES = ["pb", "volume", "turnover"]


def labelled(spark, d):
    df = forward(spark, d)
    return df.withColumn("label", R.percent_rank("fwd", ["trade_date"])).withColumn("label_end", F.lead("trade_date").over(PANEL.history()))


@query(None)
def listwise_ranker(spark, d):
    """The whole panel ranked by a model of the labels that had ended by AS_OF."""
    df = labelled(spark, d)
    model = ranking.fit_listwise(df, FEATURES, "label", "label_end", AS_OF)
    return rounded(model.predict(df), "symbol", "trade_date", "percentile", "rank")


@query(None)
def listwise_ndcg(spark, d):
    """How well the dates after AS_OF are ranked."""
    df = labelled(spark, d)
    model = ranking.fit_listwise(df, FEATURES, "label", "label_end", AS_OF)
    later = df.filter(F.col("trade_date") > F.lit(AS_OF))
    return rounded(ranking.ndcg(later.join(model.predict(later), PANEL.keys), "label"), "trade_date", "ndcg")
