"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Bits of a map of hashes, a power of two: 8 MB, whatever the table.
MAP_BITS = 1 << 26


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or what setCheckpointDir set. Where neither is set, a
    temporary one in local mode, and an error on a cluster, whose executors could not read it."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="loomspark-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path of its own under the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def through_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: cuts lineage and survives lost executors."""
    spark, schema = df.sparkSession, df.schema
    df.write.parquet(path := fresh_path(spark, name))
    return spark.read.schema(schema).parquet(path)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def id_and_text(docs: DataFrame) -> DataFrame:
    """doc_id and text alone: other columns, whatever their names, do not reach the operators. Null text is empty."""
    return docs.select(F.col("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def one_core() -> None:
    """Tokenizers work on the core of the task that calls them, unless the environment says otherwise."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Batches of fewer rows: as many texts as a worker makes strings of at a time."""
    for batch in batches:
        yield from (batch.slice(a, rows) for a in range(0, batch.num_rows, rows))


def arrow(df: pd.DataFrame | dict, schema: pa.Schema) -> pa.RecordBatch:
    """A record batch of the given columns in the schema's order."""
    return pa.RecordBatch.from_arrays([pa.array(df[f.name], f.type) for f in schema], schema=schema)


def bit_map(hashes: DataFrame) -> Callable[[np.ndarray], np.ndarray]:
    """A function that says of each of an array of longs whether it may be among the hashes in the one column, by a
    broadcast map of MAP_BITS bits. It errs to one side only: what is among them is always told."""
    bit = F.col(hashes.columns[0]).bitwiseAND(F.lit(MAP_BITS - 1))
    set_bits = F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit.bitwiseAND(F.lit(63)).cast("int")))
    words = hashes.groupBy(F.shiftright(bit, 6).cast("int").alias("word")).agg(set_bits.alias("bits")).filter("word is not null").toArrow()
    bits = np.zeros(MAP_BITS // 64, np.int64)
    bits[words.column(0).to_numpy()] = words.column(1).to_numpy()
    shared = hashes.sparkSession.sparkContext.broadcast(bits)

    def there(x: np.ndarray) -> np.ndarray:
        place = x & (MAP_BITS - 1)
        return ((shared.value[place >> 6] >> (place & 63)) & 1).astype(bool)

    return there


class Concerned:
    """Rows whose key may be among the hashes, and those whose key is not: no row is moved to tell them apart."""

    def __init__(self, hashes: DataFrame, rows: DataFrame, key: Column):
        self.rows, self.key, self.there = rows, key, bit_map(hashes)

    def _chosen(self, wanted: bool) -> DataFrame:
        names, there = self.rows.columns, self.there

        def choose(batches):
            for batch in batches:
                keep = there(batch.column(len(names)).to_numpy(zero_copy_only=False))
                yield pa.RecordBatch.from_arrays(batch.columns[: len(names)], names).filter(pa.array(keep == wanted))

        return self.rows.select("*", self.key.alias("key of the map")).mapInArrow(choose, self.rows.schema)

    def some(self) -> DataFrame:
        return self._chosen(True)

    def others(self) -> DataFrame:
        return self._chosen(False)
