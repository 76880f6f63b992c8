"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftlab.session import materialise, release


def _lowest(rows: DataFrame) -> DataFrame:
    """(u, m, n) per node of rows (u, v): its smallest neighbour and their number."""
    return materialise(rows.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "cc-low")


def connected_components(edges: DataFrame, a: str = "u", b: str = "v", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node on an edge; component is the smallest node reachable.

    Each star step finds the smallest neighbour per node by a pre-aggregated sum and writes it; the edges are then joined with
    that table, so both sides of the join are plain shuffles, which Spark splits where a hub has many edges. A node with a smaller
    neighbour and a second one is open; without open nodes the edges are stars around their smallest nodes, and the rounds end. Null
    ends and self-loops are left out; repeated edges count once; an empty edge table gives an empty result.
    """
    given = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    edges = materialise(given.distinct(), "cc-edges")
    for _ in range(max_rounds):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = _lowest(both)
        if low.filter("m < u and n > 1").isEmpty():
            release(low)
            break
        near = low.select("u", F.least("m", "u").alias("m"))
        large = both.filter("v > u").join(near, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        moved = materialise(large, "cc-large")
        release(low, edges)
        low = _lowest(moved)
        small = moved.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).distinct()
        edges = materialise(small, "cc-small")
        release(low, moved)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots.select("node", F.col("node").alias("component")))
