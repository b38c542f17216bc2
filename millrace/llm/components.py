"""Connected components by alternating star contraction, on edges that stay distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _print(edges: DataFrame) -> tuple:
    """How many edges there are, and two sums of hashes: alike if a round changed nothing."""
    sums = [F.sum(F.xxhash64("u", "v", F.lit(seed)).cast("decimal(38,0)")) for seed in (1, 2)]
    return tuple(edges.agg(F.count(F.lit(1)), *sums).first())


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``node, root`` for each node of ``edges`` (u, v); the root is the component's smallest node.

    Large-star and small-star steps in turn (each a group-by with a join back)
    until the edges form stars; the number of rounds grows with the logarithm of
    the nodes. Each round is cut off from the last in the shared folder. Minima
    are combined before they shuffle and are tables of their own, so that
    adaptive execution can split the join back at a node with many edges. Self
    loops and repeated edges are allowed; without edges the result is empty.
    """
    e = cut(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = _print(e)
    for _ in range(most_rounds if before[0] else 0):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = cut(large)
        low = cut(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("p")).select("p.u", "p.v").filter("u <> v").distinct()
        new = cut(small)
        after = _print(new)
        if after == before:
            break
        e, before = new, after
    else:
        if before[0]:
            raise RuntimeError(f"no fixed point after {most_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
