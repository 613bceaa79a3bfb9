"""Connected components of an edge table, by alternating large and small stars; nothing but counts reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lattica.llm import staging


def connected(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, least): for each node of the undirected edges (a, b), the least node that it reaches.

    Each round points the larger neighbours of a node at its least one, then the smaller ones; neither step collects a
    node's neighbours, so a node may have any number of them. Rounds are written to the shared folder, the last one stays there. Edges with a null
    end and loops are left out; a loop's node isn't returned unless another edge has it.
    """
    high, low = F.greatest(a, b), F.least(a, b)
    now = staging.written(edges.filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(high.alias("u"), low.alias("v")).distinct())
    while not _stars(now):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # written, so that the join's tasks for a node with very many neighbours can be split
        pointed = staging.written(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")))
        large = both.filter("v > u").join(pointed, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        following = staging.written(moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        staging.drop(pointed)
        staging.drop(now)
        now = following
    # what the rounds have broadcast and shuffled goes when the driver collects garbage, by itself every half hour only
    edges.sparkSession._jvm.System.gc()
    return now.select(F.col("u").alias("node"), F.col("v").alias("least")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("least")).distinct())


def _stars(edges: DataFrame) -> bool:
    """Whether every node points at one node that points at none: then nothing is left to do."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("points")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("points")))
    told = ends.groupBy("node").agg(F.sum("points").alias("points"), F.count(F.lit(1)).alias("n"))
    others = F.count_if((F.col("points") > 1) | (F.col("points") > 0) & (F.col("points") < F.col("n")))
    return told.agg(others).first()[0] == 0
