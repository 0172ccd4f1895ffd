"""Connected components of a graph of links, as DataFrame operations.

Alternating large and small stars: in a large star every neighbour above a node is linked to the node's smallest
neighbour, in a small star every neighbour below it (and the node) is. The links shrink to one star for each component,
in a number of rounds that grows with the logarithm of the size. Each round is kept in the checkpoint folder; nothing
but two sums reaches the driver. A hub's many links are an equi-join's hot key, which Spark splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from morpholake.llm.blocks import checkpointed, dropped


def loose(key: Column) -> Column:
    """The same integer without what is known of how its rows are dealt: a join on it deals both sides anew, and only then can Spark split a hot key's partition."""
    return key.bitwiseXOR(F.lit(0).cast("bigint"))


def _star(links: DataFrame, large: bool) -> DataFrame:
    """links: (a, b), a > b. large: over both directions."""
    out = links.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        out = out.unionAll(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = out.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")).select(loose(F.col("u")).alias("w"), "m")
    both = out.join(least, F.col("u") == F.col("w"))
    if large:
        new = both.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        new = both.select(F.explode(F.array(F.struct(F.col("v").alias("a"), F.col("m").alias("b")), F.struct(F.col("u").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.*")
    return new.where("a > b").distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of links (bigint ids, in either order, repeats and loops allowed); component is the smallest node reachable.

    A node that only links to itself is left out. No links give no rows; links with a null end are ignored.
    """
    links = links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"), F.col(a).isNotNull() & F.col(b).isNotNull()).toDF("a", "b", "whole").where("whole and a > b").drop("whole").distinct()
    links = checkpointed(links)
    seen = None
    while True:
        sums = links.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
        if tuple(sums) == seen or not sums[0]:
            break
        seen = tuple(sums)
        before, links = links, checkpointed(_star(_star(links, True), False))
        dropped(before)
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
