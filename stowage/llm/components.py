"""Connected components of a link table, by alternating star contractions on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stowage.llm.common import stage_table


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node that has a link; root is the smallest node reachable.

    ``links``: a, b (any comparable type; direction and repeats don't matter).  Each round
    points all larger neighbours of a node at its smallest neighbour, then all smaller
    ones; the rounds end when the links no longer change, which takes about the
    logarithm of the longest path (large-star / small-star).  Every step is an aggregate
    or a join of two shuffled tables, so a node with very many links is pre-aggregated or split
    by Spark, and each round is written to the shared folder.
    """
    e = stage_table(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                    .distinct(), "links")
    state = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = stage_table(small.unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "links")
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    roots = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
