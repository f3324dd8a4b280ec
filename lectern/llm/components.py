"""Connected components by alternating star contractions, edges only.

Every round is two grouped aggregations and joins over the edges that are left;
no node's neighbours are ever gathered. A hub's edges meet one row, the smallest of
its neighbours, in a join whose larger side adaptive execution splits. Each round's
edges are written to the shared folder, and the round's before are removed. Edges become stars around the smallest
node of each component in a number of rounds that grows as the logarithm of the
longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import drop_staged, staged


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours are linked to the smallest of it and its neighbours."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).where("a != b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are linked to the smallest neighbour."""
    down = edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).where("a != b")
    return moved.unionByName(least.select(F.col("m").alias("a"), F.col("u").alias("b"))).distinct()


def connected(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """node, root (the smallest node) of all nodes of ``edges(a, b)``, a < b."""
    state = lambda e: e.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
    now = staged(edges)
    seen = state(now)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        new = staged(_small_star(_large_star(now)))
        drop_staged(now)
        now, was, seen = new, seen, state(new)
        if seen == was:
            break
    else:
        raise RuntimeError(f"no fixed point in {max_rounds} rounds")
    return now.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(now.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
