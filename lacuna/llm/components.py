"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.llm.common import scratch, staged


def _least(pairs: DataFrame, name: str) -> DataFrame:
    """pairs (u, v), each once -> u, least (of its v), n (their number)."""
    return staged(pairs.groupBy("u").agg(F.min("v").alias("least"), F.count("*").alias("n")), name)


def _with_least(pairs: DataFrame, least: DataFrame) -> DataFrame:
    """pairs (u, v) with m, the least of u and its v. A node may be in a third of all pairs: its least is found
    by sums of each task, and goes back by a join of tables, which can split a large key."""
    return pairs.join(least.select("u", "least"), "u").select("u", "v", F.least("u", "least").alias("m"))


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """edges (u long, v long) -> (node, component) of each node that has an edge to another, component its least node.

    Loops, repeated and reversed edges count once; nodes with null are left out. Each round's edges are written as a table, so
    the plan does not grow. Raises if the components are not settled after so many rounds; each round at least halves
    what a path has left.
    """
    stars = staged(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    for _ in range(rounds):
        both = stars.union(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = _least(both, "large-least")
        # Settled: a node's neighbours are all greater, or it has one, which is less and so has a greater one. Then the least tells all.
        if not least.agg(F.bool_or(F.expr("least < u AND n > 1"))).first()[0]:
            return least.select(F.col("u").alias("node"), F.least("u", "least").alias("component"))
        with scratch(edges.sparkSession):
            large = _with_least(both, least).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            small = staged(large.distinct(), "small")
            small = _with_least(small, _least(small, "small-least"))
            small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", "m")).where("u <> v").distinct()
            stars = staged(small, "stars", keep=True)
    raise RuntimeError("components did not settle")
