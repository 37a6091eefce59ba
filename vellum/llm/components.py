"""Connected components of a graph too large for one machine: alternating large and small stars.

Each round is two shuffles of the edges; the edges are checkpointed, so a lost executor costs one
round. A vertex with very many neighbours is no single task's work: its least neighbour is a map-side
combined aggregate, and is broadcast to the edges where they lie (join_groups).
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import checkpoint, join_groups

#: Edges that one task takes, about. The number of tasks follows the edges, so that small graphs don't pay for many tasks.
TASK_EDGES = 100_000


def _star(edges: DataFrame, large: bool, n: int) -> DataFrame:
    """n edges (u, v), u > v. Large: each vertex's larger neighbours are hung on its least neighbour; small: its smaller ones and itself."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
    joined = join_groups(both, least, ["u"], "n", 2 * n if large else n, most=2 * n)
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u > v").repartition(max(1, math.ceil(n / TASK_EDGES)), "u", "v").distinct()


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """(id, root) of every vertex of edges (u, v); root: its component's least vertex. Loops are dropped."""
    edges = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = checkpoint(edges)
    n = edges.count()  # it never grows
    seen = None
    for _ in range(most):
        edges = checkpoint(_star(_star(edges, True, n), False, n))
        now = tuple(edges.agg(F.count("*"), F.sum("v"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("the components did not settle")
    roots = edges.select("v").distinct()
    return edges.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(roots.select(F.col("v").alias("id"), F.col("v").alias("root")))
