"""Connected components of a graph given by its links, in rounds of two star operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.llm.common import through_table


def connected_components(links: DataFrame) -> DataFrame:
    """node, root: the smallest node reachable from each node that links (a, b) name.

    Each round ties every node's larger neighbours to its smallest one, then its smaller neighbours and itself; a
    component becomes a star around its smallest node in a number of rounds that grows with the logarithm of its
    size, and rounds end when one changes nothing. Each round is written as a table: rounds do not depend on executors
    that ran earlier ones. No links: no rows.
    """
    edges = through_table(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "links")
    before = None
    while True:
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        smallest = large.groupBy("u").agg(F.min("v").alias("m"))
        tied = large.join(smallest, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = through_table(tied.union(smallest).filter("u <> v").distinct(), "links")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select("v", "v").distinct())
