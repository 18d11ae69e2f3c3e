"""Connected components by alternating large-star and small-star rounds, in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _print(edges: DataFrame) -> tuple[int, int, int]:
    """Number of edges and two independent hashes over all of them, 64 and some 20 bits wide."""
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x"), F.sum(F.xxhash64(F.lit(17), "a", "b") % 1_000_003).alias("h")).first()
    return row["n"], row["x"] or 0, row["h"] or 0


def connected_components(edges: DataFrame, src: str, dst: str, max_rounds: int = 60) -> DataFrame:
    """Rows (node, component) for every node of an edge; component is the smallest node reachable.

    Each round is two grouped minima (combined map-side) and two joins against one row per node, so a
    hub with a third of all edges is a skewed join side that Spark splits, never a collected group.
    Null ends and self loops link nothing. No edges: no rows. Edges are written to the shared folder
    once a round. Rounds grow with the logarithm of the longest path.
    """
    e = edges.select(F.col(src).alias("x"), F.col(dst).alias("y")).where("x is not null and y is not null and x <> y")
    e = written(e.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct(), "edges")
    before = _print(e)
    for _ in range(max_rounds):
        if not before[0]:
            break
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        e = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: every edge now points from the larger node to a smaller one
        low = e.groupBy("a").agg(F.min("b").alias("m"))
        far = e.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = written(far.unionByName(low.select("a", F.col("m").alias("b"))).distinct(), "edges")
        now = _print(e)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = e.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
