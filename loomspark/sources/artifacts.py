"""Tables in and out: files by their extension, dates in several spellings, signal artifacts with a sidecar."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence
from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomspark.functions import recipes as R
from loomspark.operators.panel import keep_one

SIGNALS = T.StructType([
    T.StructField("trade_date", T.StringType()), T.StructField("symbol", T.StringType()), T.StructField("signal", T.DoubleType()),
    T.StructField("rank", T.LongType()), T.StructField("model_version", T.StringType()), T.StructField("feature_set_id", T.StringType()),
    T.StructField("eligible", T.BooleanType()), T.StructField("run_id", T.StringType()),
])


def load(spark: SparkSession, path: str) -> DataFrame:
    """A table by its extension: parquet, json (one document), jsonl or csv with a header."""
    kind = path.rstrip("/").rpartition(".")[2].lower()
    if kind in ("parquet", "pq"):
        return spark.read.parquet(path)
    if kind == "json":
        return spark.read.option("multiLine", True).json(path)
    if kind == "jsonl":
        return spark.read.json(path)
    if kind == "csv":
        return spark.read.option("header", True).option("inferSchema", True).csv(path)
    raise ValueError(f"unknown kind of table: {path}")


def partitioned(spark: SparkSession, root: str, files: Sequence[str]) -> DataFrame:
    """Parquet files under a root with partition folders, columns united by name."""
    return spark.read.option("basePath", root).option("mergeSchema", True).parquet(*files)


def as_date(x: str) -> Column:
    """A date from YYYYMMDD, the same with .0 after it, or ISO text."""
    text = F.regexp_replace(F.trim(F.col(x).cast("string")), r"\.0$", "")
    return F.coalesce(F.try_to_date(text, "yyyyMMdd"), F.try_to_date(F.substring(text, 1, 10), "yyyy-MM-dd"))


def merged(frames: Sequence[DataFrame], keys: Sequence[str], order: str) -> DataFrame:
    """Signal tables as one, by full outer joins; of rows with equal keys the last by ``order`` counts."""
    one = [keep_one(f, keys, [F.col(order).desc()]).drop(order) for f in frames]
    return reduce(lambda a, b: a.join(b, list(keys), "full_outer"), one)


def signals(scored: DataFrame, score: str, model_version: str, feature_set_id: str, run_id: str, eligible: str | None = None) -> DataFrame:
    """The columns of a signal artifact, ranked by score within each date, the first the best."""
    rank = F.when(F.col(score).isNotNull(), R.first_rank(score, ["trade_date"], ["symbol"], descending=True))
    return scored.select(
        F.date_format(F.to_date("trade_date"), "yyyyMMdd").alias("trade_date"), F.col("symbol").cast("string").alias("symbol"), R.clean(F.col(score)).alias("signal"), rank.cast("long").alias("rank"),
        F.lit(model_version).alias("model_version"), F.lit(feature_set_id).alias("feature_set_id"), (F.col(eligible) if eligible else F.lit(True)).alias("eligible"), F.lit(run_id).alias("run_id"),
    )


def violations(found: DataFrame) -> list[str]:
    """What is wrong with a signal table, in words; one aggregation."""
    wrong = [f"column {f.name} is missing or not {f.dataType.simpleString()}" for f in SIGNALS if f.name not in found.columns or found.schema[f.name].dataType != f.dataType]
    if wrong:
        return wrong
    n = found.agg(
        F.count(F.lit(1)).alias("rows"), F.count(F.when(~F.coalesce(F.col("trade_date").rlike(r"^\d{8}$"), F.lit(False)), 1)).alias("bad dates"),
        F.count(F.when(F.coalesce(F.trim("symbol"), F.lit("")) == "", 1)).alias("empty symbols"), F.count(F.when(F.isnan("signal") | (F.abs("signal") == float("inf")), 1)).alias("signals that are no numbers"),
    ).first()
    again = found.groupBy("trade_date", "symbol").count().filter("count > 1").count()
    return ([] if n["rows"] else ["no rows"]) + [f"{n[k]} {k}" for k in ("bad dates", "empty symbols", "signals that are no numbers") if n[k]] + ([f"{again} keys repeat"] if again else [])


def fingerprint(df: DataFrame) -> str:
    """A hash of the rows whatever their order."""
    row = F.xxhash64(*sorted(df.columns)).cast("decimal(38,0)")
    n, s = df.agg(F.count(F.lit(1)), F.sum(row)).first()
    return hashlib.sha256(f"{n} {s}".encode()).hexdigest()


def write_signals(found: DataFrame, path: str, configuration: dict, lineage: Sequence[str] = ()) -> dict:
    """Write a valid signal table as Parquet with a sidecar of one JSON row beside it; returns the sidecar."""
    if wrong := violations(found):
        raise ValueError("; ".join(wrong))
    found.write.mode("overwrite").parquet(path)
    written = found.sparkSession.read.schema(SIGNALS).parquet(path)
    about = {"created": datetime.now(timezone.utc).isoformat(), "rows": written.count(), "content": fingerprint(written), "configuration": hashlib.sha256(json.dumps(configuration, sort_keys=True).encode()).hexdigest(), "lineage": list(lineage)}
    found.sparkSession.createDataFrame([(json.dumps(about, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path.rstrip("/") + ".metadata")
    return about


def read_signals(spark: SparkSession, path: str, validate: bool = True) -> DataFrame:
    found = spark.read.schema(SIGNALS).parquet(path)
    if validate and (wrong := violations(found)):
        raise ValueError("; ".join(wrong))
    return found


def read_metadata(spark: SparkSession, path: str) -> dict:
    return json.loads("".join(r[0] for r in spark.read.text(path.rstrip("/") + ".metadata").collect()))
