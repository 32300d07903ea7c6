"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.plans.shared import stored


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """node, component (smallest node reachable) for every node of an undirected edge table.

    Self loops name their node; rows with a null end are left out. Each round hooks every node to the least
    neighbour of its neighbourhood, so the number of rounds grows with the logarithm of the diameter. Hubs cost one
    partial minimum per partition and a join that adaptive execution can split.
    """
    pairs = stored(edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null"))  # read twice
    nodes = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    now = stored(pairs.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    while True:
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u != v").distinct()
        now = stored(small)
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(mark) == before:
            break
        before = tuple(mark)
    return nodes.join(now.select(F.col("u").alias("node"), F.col("v").alias("c")), "node", "left").groupBy("node").agg(F.min(F.coalesce("c", "node")).alias("component"))
