"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstat.llm._common import checkpointed


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def components(edges: DataFrame, max_rounds: int = 64, nodes: int | None = None) -> DataFrame:
    """Smallest reachable node of every node that has an edge.

    ``edges`` has two comparable columns ``a`` and ``b``. Alternates large-star and small-star
    rounds until the edge set, which never grows beyond the number of edges, is a forest of
    stars. Every round ends in a checkpoint, so lineage stays short and a lost executor costs
    one round. Returns ``node, component``; the smallest node of a component is listed too.
    An empty edge list gives an empty table. ``nodes``, a bound of the nodes if known, only sets in
    how many files the edges are kept. Raises if ``max_rounds`` rounds do not converge.
    """
    now = checkpointed(edges.select("a", "b").where("a <> b").distinct(), nodes)
    # Order-independent digest of the edge set; the decimal sum cannot overflow.
    mark = lambda df: df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    seen = mark(now)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        now = checkpointed(_small_star(_large_star(now)), seen[0])
        then = mark(now)
        if then == seen:
            break
        seen = then
    else:
        raise RuntimeError("components did not converge")
    leaves = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return leaves.union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
