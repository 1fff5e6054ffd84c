"""Connected components of a graph too large for one machine, by alternating large-star and small-star steps until nothing moves."""
from pyspark.sql import DataFrame, functions as F

from tidemark.runtime import cut_lineage


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): every node that has an edge, with the smallest node reachable from it. Nulls and loops are left out; repeated edges count once.

    Both steps point a node's neighbours at the smallest of them, so a path shortens by a constant factor a round and the number of rounds grows with the logarithm of
    the longest path; there is no round limit. A step is a grouped minimum (combined before the shuffle) joined back by equality, whose hot side AQE splits.
    """
    cur = cut_lineage(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u is not null and v is not null and u <> v").distinct())
    state = _state(cur)
    while state[0]:
        nxt = cut_lineage(_small_star(_large_star(cur)))
        moved = _state(nxt)
        cur = nxt
        if moved == state:
            break
        state = moved
    return cur.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(cur.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _state(edges):
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _large_star(edges):
    """Every larger neighbour of a node points at the node's smallest neighbour (the node itself counts)."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m"))
    return both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()


def _small_star(edges):
    """A node and its smaller neighbours point at the smallest of them."""
    low = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(low, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct()
