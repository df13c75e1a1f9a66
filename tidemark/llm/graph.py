"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import stored
from tidemark.session import cut_lineage


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node of the component, for each node of ``edges`` (u, v).

    Rounds of large-star and small-star joins; the rounds grow with the logarithm of the longest path. Minima per
    node combine before the shuffle, and a node with very many edges is split by the skew join.

    The edges of a round are a stored table, whose size Spark knows. A checkpoint keeps the estimate of its plan, a join
    multiplies those of its sides, and so the estimate's digits, all held in the driver, would grow with each round by
    a factor.
    """
    big, small = F.greatest("u", "v"), F.least("u", "v")
    now = stored(edges.filter("u <> v").select(big.alias("u"), small.alias("v")).distinct())
    before = None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if state == before or not state[0]:
            break
        before = state
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # minima are kept apart, so that the joins have shuffles of their own and can split a hot node
        least = cut_lineage(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # the smaller neighbours of a node and the node itself go to the least of them
        large = cut_lineage(large.distinct())
        least = cut_lineage(large.groupBy("u").agg(F.min("v").alias("m")))
        moved = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # a node's least neighbour found above its own edges is kept as an edge as well
        own = least.select("u", F.col("m").alias("v"))
        now = stored(moved.unionByName(own).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    roots = now.select(F.col("v").alias("node")).distinct()
    roots = roots.join(now.select(F.col("u").alias("node")), "node", "left_anti")
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(roots.withColumn("label", F.col("node")))
