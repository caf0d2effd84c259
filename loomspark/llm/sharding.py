"""Sharding by vector bin packing: bytes, tokens and rows are balanced jointly.

Documents of equal text are a group and share a shard. Placing is greedy and works on a bounded number of units:
each group of over 1 / ``LARGE`` of any total is a unit of its own (there are at most 3 * LARGE of them), and all
others are dealt into ``CELLS`` cells by their text's digest. A group of more than a shard's capacity is itself dealt
into parts of half of it at most; any other stays whole.

Units go, largest first, where the dot product of their size with the residual capacity is highest, also where none has
room any more. Law: ``bytes``, which weigh most; units of small cells come last and level what is left of all three.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomspark.llm.common import through_table

CELLS = 1 << 13
LARGE = 1 << 12
#: Rows of a unit that are numbered in one window, on average at most: units of more are numbered in salted parts.
NUMBERED = 1 << 20
#: Weights of bytes, tokens and rows in the dot product.
WEIGHTS = (0.998, 0.001, 0.001)


def placed(sizes: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each unit; sizes: bytes, tokens and rows of each as shares of the totals.

    Of the shards with room for a unit in every dimension, that of the highest dot product is taken; where none
    has room, the same among all. Ties go to the lowest shard.
    """
    out = np.zeros(len(sizes), np.int64)
    residual = np.full((shards, 3), 1 / shards)
    weights = np.array(WEIGHTS)
    for i in np.lexsort((np.arange(len(sizes)), -sizes[:, 0])):
        score = residual @ (weights * sizes[i])
        fits = (residual >= sizes[i] - 1e-12).all(1)
        out[i] = k = int(np.argmax(np.where(fits, score, -np.inf) if fits.any() else score))
        residual[k] -= sizes[i]
    return out


def shard_documents(docs: DataFrame, shards: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard: one row for each row of ``docs``.

    size: UTF-8 bytes of the text plus 1; null text has none and is a group of its own, apart from the empty text.
    slot: 0, 1, 2 … within a shard, without gaps. grown_shard is null, as the law is ``bytes``. Repeated rows and
    ids each have a slot; empty input gives no rows; other columns are ignored. Texts of any length are read for their
    size and digest alone. Groups over a shard's capacity, 1 / shards of a total, are split; all others stay whole.
    """
    spark = docs.sparkSession
    text = F.col("text").cast("string")
    words = F.length(text) - F.length(F.replace(text, F.lit(" "))) + 1  # blanks stand for tokens
    rows = docs.select(
        F.col("doc_id").cast("long"),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1).alias("size"),
        F.coalesce(words, F.lit(0)).cast("long").alias("tokens"),
        F.crc32(F.encode(F.coalesce(text, F.lit("")), "utf-8")).alias("text_crc32"),
        F.unhex(F.coalesce(F.md5(F.encode(text, "utf-8")), F.lit(""))).alias("digest"),
    )
    rows = through_table(rows, "shard-rows")
    groups = rows.groupBy("digest").agg(F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("n"))
    total = rows.agg(F.sum("size"), F.sum("tokens"), F.count(F.lit(1))).first()
    if not total[2]:
        return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    totals = [max(1, x) for x in total]
    share = F.greatest(*(F.col(c) / F.lit(float(t)) for c, t in zip(("size", "tokens", "n"), totals)))
    large = groups.filter(share > 1 / LARGE).select("digest", share.alias("share"), F.when(share > 1 / shards, F.ceil(share * (2 * shards)).cast("int")).otherwise(1).alias("parts"))
    large = large.select("digest", "parts", F.hex("digest").alias("name"))  # at most 3 * LARGE rows, by their share
    # a unit: a part of a large group, or a cell of others
    part = F.pmod(F.xxhash64("doc_id", "text_crc32"), F.col("parts").cast("long"))
    cell = F.concat(F.lit("cell-"), F.pmod(F.xxhash64("digest"), F.lit(CELLS)).cast("string"))
    named = rows.join(F.broadcast(large), "digest", "left").withColumn("unit", F.coalesce(F.concat_ws("-", "name", F.when(F.col("name").isNotNull(), part.cast("string"))), F.lit("")))
    named = named.withColumn("unit", F.when(F.col("name").isNull(), cell).otherwise(F.col("unit")))
    salts = max(1, -(-totals[2] // (NUMBERED * 64)))
    named = named.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int"))
    counted = named.groupBy("unit", "salt").agg(F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("n"))
    units = counted.orderBy("unit", "salt").toPandas()  # CELLS, and the parts of large groups, times salts
    by_unit = units.groupby("unit", sort=True)[["size", "tokens", "n"]].sum()
    by_unit["shard"] = placed(by_unit.to_numpy(float) / np.array(totals, float), shards)
    units["shard"] = by_unit["shard"].reindex(units["unit"]).to_numpy()
    units["base"] = units.groupby("shard")["n"].cumsum() - units["n"]
    where = spark.createDataFrame(units[["unit", "salt", "shard", "base"]].astype({"unit": str, "salt": "int32", "shard": "int32", "base": "int64"}))
    order = Window.partitionBy("unit", "salt").orderBy("doc_id", "text_crc32", "size")
    numbered = named.withColumn("nth", F.row_number().over(order)).join(F.broadcast(where), ["unit", "salt"])
    return numbered.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), (F.col("base") + F.col("nth") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
