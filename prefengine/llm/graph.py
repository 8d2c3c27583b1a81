"""Connected components of a large edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefengine.llm.common import shared_table


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b: long): root is the smallest node reachable.

    Alternates large-star and small-star steps: each hooks the neighbours of a node to their smallest
    one, so the number of edges never grows and long chains shrink by a factor each round.  Each round
    is written to the shared folder; nothing of the graph comes to the driver but its size and hash."""
    now = edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    now, before = shared_table(now, "edges"), None
    for _ in range(rounds):
        state = now.agg(F.count(F.lit(1)).alias("n"), F.expr("bit_xor(xxhash64(a, b))").alias("h")).first()
        if state["n"] == 0 or state == before:
            break
        before = state
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("m").alias("a"), "b").filter("a <> b").distinct()
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(least, "b").select("m", F.explode(F.array("a", "b")).alias("b")).filter("m <> b")
        now = shared_table(small.select(F.col("m").alias("a"), "b").distinct(), "edges")
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = now.select(F.col("a").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return now.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(roots)
