"""Connected components of a link table, by alternating large-star and small-star steps.

Every step is one aggregation (partial sums first, so a vertex of a third of all links is no hot task) and one join, and is
written to the shared folder, so neither links nor components ever meet in one task or on the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.llm.common import stored


def _large_star(edges: DataFrame) -> DataFrame:
    """Edges (hi, lo): each vertex links its larger neighbours to its smallest one."""
    both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(edges.select("lo", "hi"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).where("hi <> lo").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each vertex links its smaller neighbours and itself to the smallest of them."""
    least = edges.groupBy("hi").agg(F.min("lo").alias("m"))
    moved = edges.join(least, "hi")
    return (
        moved.where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        .union(least.select("hi", F.col("m").alias("lo"))).distinct()
    )


def connected_components(links: DataFrame) -> DataFrame:
    """(id, component) for every vertex of links(a, b); the component is its smallest id. Loops and repeats are allowed."""
    a, b = F.col("a"), F.col("b")
    edges = stored(
        links.where(a.isNotNull() & b.isNotNull() & (a != b))
        .select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct()
    )
    while not edges.isEmpty():
        edges = stored(_small_star(_large_star(edges)))
        # Done when every vertex is linked to one other, which is linked to none.
        split = edges.groupBy("hi").agg(F.count("*").alias("n")).where("n > 1").select("hi")
        inner = edges.join(edges.select(F.col("hi").alias("lo")), "lo", "left_semi").select("hi")
        if split.union(inner).isEmpty():
            break
    return edges.select(F.col("hi").alias("id"), F.col("lo").alias("component")).union(
        edges.select("lo", "lo").distinct()
    )
