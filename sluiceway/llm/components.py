"""Connected components of an edge table by alternating star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import cut


def components(edges: DataFrame) -> DataFrame:
    """(node, root): for every node with an edge, the smallest node it can reach.

    ``edges`` has columns a and b (any order; loops and repeats do no harm). In a round each node
    links its larger neighbours to its smallest one, then its smaller neighbours and itself to
    the smallest. Long chains shrink by half or more. Rounds go on until the table stays
    as it is; a hot node is only ever an aggregate and one side of a join.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    before = None
    while True:
        e = cut(e)
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.sum(F.col("u").cast("decimal(38,0)"))).first()
        if now == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select("v", "v").distinct())
        before = now
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # a node that is the smallest of all its neighbours gets its edges from them
        smallest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(smallest, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = small.union(smallest.select("u", "m")).distinct()
