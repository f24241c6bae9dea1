"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .shared import join_counted, materialise

#: With fewer edges the least neighbours of all nodes are broadcast: 16 bytes a node, two nodes an edge at most.
FEW_EDGES = 250_000


def with_least(edges: DataFrame, n: int) -> DataFrame:
    """``edges`` (u, v), ``n`` of them, with ``m``, the least of u and its v; no task gets all edges of a hub."""
    # Sums come partially before the shuffle, so a hub is no hot key here; in the join it would be.
    least = edges.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count(F.lit(1)).alias("held"))
    if n <= 2 * FEW_EDGES:
        return edges.join(F.broadcast(least.drop("held")), "u")
    return join_counted(edges, materialise(least, "least-neighbours"), ["u"], "held", n).drop("held")


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node that each node of ``edges`` (a, b) reaches.

    Each round hangs every node's larger, then smaller neighbours onto the least one it
    sees, which shortens all paths; rounds end when the edges stay as they are, however
    many that takes. Every round is written to the shared folder. Loops and repeated
    edges do no harm.
    """
    state = lambda df: tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    now = materialise(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), "star")
    seen = state(now)
    while seen[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = with_least(both, 2 * seen[0]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = with_least(large, 2 * seen[0])
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        now = materialise(small.where("u != v").distinct(), "star")
        before, seen = seen, state(now)
        if seen == before:
            break
    return now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
