"""Connected components of a link table by alternating large-star and small-star steps.

Every step is one aggregate and one join on the node, both of which Spark can split when a node has very many
links; lineage is cut by a written table after every round. Only two counts a round reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .work import stored


def _star(links: DataFrame, large: bool) -> DataFrame:
    """links: (a, b), a > b. Each node's neighbours are tied to the least of them."""
    if large:
        both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
    else:
        both = links.select(F.col("a").alias("u"), F.col("b").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    least = least.select("u", F.least("u", "m").alias("m"))
    tied = both.join(least, "u")
    if large:
        out = tied.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = tied.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of links(a, b); the root is the smallest node of the component."""
    current = stored(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    for _ in range(most_rounds):
        total, nodes = current.agg(F.count("*"), F.count_distinct("a")).first()
        # done when every node has one link, to a node that has none upwards
        if total == nodes and current.select("b").distinct().join(current.select(F.col("a").alias("b")), "b", "left_semi").isEmpty():
            break
        current = stored(_star(_star(current, True), False))
    else:
        raise RuntimeError(f"no fixed point after {most_rounds} rounds")
    return current.select(F.col("a").alias("node"), F.col("b").alias("root")).union(current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
