"""Connected components of an edge table by alternating star contraction (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm.scratch import Scratch, with_group


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``(id, component)`` of every vertex that has an edge to another; component is its smallest id.

    ``edges`` has long columns ``a`` and ``b`` in any order, with repeats and loops. Every round is
    two minimum aggregations, combined before their shuffle, each joined back to the edges and written. The
    join keeps edges of hot vertices where they are (``with_group``), so no task gets a vertex's edges
    and no adjacency list is gathered. Loops and edges with a null end count for nothing.
    """
    stars = scratch.save(_directed(edges), "edges")
    while True:
        both = stars.unionAll(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = scratch.save(both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("_n")), "lowest")
        large = scratch.save(with_group(both, lowest, ["u"]).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct(), "large")
        scratch.drop(stars, lowest)
        # with one neighbour each and no chain, all edges lead to roots
        if large.groupBy("u").count().where("count > 1").unionAll(large.join(large.select(F.col("u").alias("v")), "v", "left_semi").select("u", F.lit(1))).isEmpty():
            break
        least = scratch.save(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("_n")), "least")
        small = with_group(large, least, ["u"]).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        stars = scratch.save(small.unionAll(least.select("u", F.col("m").alias("v"))).distinct(), "stars")
        scratch.drop(large, least)
    roots = large.select(F.col("v").alias("id")).distinct().withColumn("component", F.col("id"))
    return large.select(F.col("u").alias("id"), F.col("v").alias("component")).unionAll(roots)


def _directed(edges: DataFrame) -> DataFrame:
    return edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
