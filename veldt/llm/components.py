"""Connected components of an edge table, by alternating large-star and small-star steps.

Both steps are joins and aggregations on the edge table, whose size never exceeds the number of
its edges; nothing is collected but two numbers a round. Each round is written to the shared
folder, so that the plan stays short and a lost executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veldt.llm.common import materialize


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    # Written first, so that the join has plain shuffles on both sides and the edges of a hub can be split.
    least = materialize(both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low")), "least")
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = materialize(down.groupBy("a").agg(F.min("b").alias("low")), "least")
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b")
    return moved.union(least.select("a", F.col("low").alias("b"))).distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``edges`` (a, b: bigint) to (node, root): the smallest node reachable from each node.

    Null ends and self-loops are left out; repeated edges count once. A node with no edge to
    another node has no row. An empty table gives an empty result.
    """
    now = edges.select(F.col("a").cast("bigint").alias("a"), F.col("b").cast("bigint").alias("b")).where("a <> b")
    now = materialize(now.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = None
    for _ in range(max_rounds):
        now = materialize(_small_star(materialize(_large_star(now), "edges")), "edges")
        state = tuple(now.agg(F.count(F.lit(1)), F.sum(F.hash("a", "b").cast("bigint"))).first())
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b", "b").distinct())
