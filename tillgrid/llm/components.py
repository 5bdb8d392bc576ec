"""Connected components of a graph given as an edge table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillgrid.llm.common import settle


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node of its component) for every node of ``edges`` (a, b) but the roots.

    Each round hangs every node's larger neighbours on its smallest one, then its
    smaller neighbours; the rounds end when the edges no longer change, after a number
    that grows with the logarithm of the graph. Minima are pre-aggregated before each
    shuffle, no neighbourhood is gathered anywhere, and every round is a written table.
    """
    now = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    now, before = settle(now, "edges"), None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == before or not state[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = tuple(state)
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = settle(small.unionByName(least.withColumnRenamed("m", "v")).distinct(), "edges")
