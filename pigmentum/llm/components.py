"""Connected components of a graph of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(r)


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """(node, root) for every node of the links (u, v): root is the smallest node reachable.

    Large-star links each node's larger neighbours to its smallest one, small-star its smaller
    ones and itself; both keep the components, and at rest every node is linked to its root alone.
    A step never has more rows than links and nodes together. Neighbours are reduced to their
    minimum before they are shuffled; those minima are checkpointed, so the join that hands them
    back to the links shuffles both sides and Spark splits the node that has very many links. The
    links are checkpointed after each round.
    """
    now = cut_lineage(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = _state(now)
    for _ in range(most):
        both = now.union(now.select("v", "u"))
        least = cut_lineage(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = cut_lineage(large)
        low = cut_lineage(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        now = cut_lineage(small)
        after = _state(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components are not at rest after {most} rounds")
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
