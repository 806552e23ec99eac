"""Connected components by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridpulse.llm.work import cut


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b); the root is the least node that it reaches.

    Each round points the neighbours of a node at the least of them, first the greater ones, then
    the lesser ones, so the rounds grow with the logarithm of the longest path. The greater ones may be
    many, so their minima are formed before the shuffle; the lesser ones are the few minima that a node was
    given. A round has no more rows than links, and the driver sees a count per round.
    """
    edges = cut(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while True:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = both.groupBy("u").agg(F.min("v").alias("m"), F.max("v").alias("far"), F.count("*").alias("n"))
        # in a star a node has lesser neighbours or greater ones, and of the lesser ones just its root
        if not near.filter("m < u and (far > u or n > 1)").agg(F.count("*")).first()[0]:
            break
        least = near.select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # the row of the least neighbour stands for the node itself
        small = large.withColumn("m", F.min("v").over(Window.partitionBy("u")))
        edges = cut(small.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).distinct())
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
