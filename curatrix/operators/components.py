"""Connected components of an undirected graph given as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curatrix.session import settled


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """(id, component) for every vertex that has an edge; component is the smallest id reachable.

    Each round takes the smallest label among a vertex's neighbours and then the label of that label
    (pointer jumping), so a chain of n vertices needs O(log n) rounds rather than n. A round is two
    shuffle joins, which adaptive execution can split at hub vertices, and a grouped minimum with map-side combine; its
    result is checkpointed in the shared folder, so a lost executor costs one round at most. Rows
    with a null end and self-loops are ignored; an empty edge table gives an empty result.
    """
    pairs = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a <> b")
    ways = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))  # the edges are read once
    both = settled(pairs.select(ways.alias("e")).select("e.*").distinct())
    labels = settled(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("n")).select("id", F.least("id", "n").alias("component")))
    for _ in range(max_rounds):
        seen = both.join(labels.select(F.col("id").alias("b"), "component"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        lowered = labels.join(seen, "id").select("id", F.least("component", "near").alias("c"), F.col("component").alias("before"))
        jump = labels.select(F.col("id").alias("c"), F.col("component").alias("further"))
        after = settled(lowered.join(jump, "c").select("id", F.least("c", "further").alias("component"), "before"))
        moved = after.where("component <> before").limit(1).count()
        labels = after.select("id", "component")
        if not moved:
            return labels
    raise RuntimeError(f"components not settled after {max_rounds} rounds")
