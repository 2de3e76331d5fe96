"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from speechcurate.session import materialise

MAX_ROUNDS = 60
# Edges to a task: small tables are not dealt over all shuffle partitions.
EDGES_PER_TASK = 100_000


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(edges: DataFrame, tasks: int) -> DataFrame:
    """Link every larger neighbour of a node to the smallest node around it."""
    both = _both_ways(edges)
    # Written, so that both sides of the join are plain tables and a hub's edges can be split.
    least = materialise(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")).coalesce(tasks), "least")
    return both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame, tasks: int) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = materialise(down.groupBy("u").agg(F.min("v").alias("m")).coalesce(tasks), "least")
    moved = down.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """``(node, component)`` for every node of ``(u, v)``; a component is named by its smallest node.

    Alternating large-star and small-star rounds. The state is written to the
    shared folder each round; a run that does not settle raises.
    """
    state = materialise(edges.filter("u <> v").distinct(), "edges")
    tasks = max(1, state.count() // EDGES_PER_TASK)
    state = materialise(state.coalesce(tasks), "edges") if tasks == 1 else state
    alone = edges.filter("u = v").select(F.col("u").alias("node"))
    for _ in range(max_rounds):
        # Settled: every node has one edge, and it leads to a node without one.
        tops = state.groupBy("u").agg(F.count("*").alias("n"), F.min("v").alias("v"))
        roots = state.select(F.col("v").alias("u")).distinct()
        open_edges = tops.join(roots, "u", "left_semi").select("u").union(tops.filter("n > 1 or v > u").select("u"))
        if open_edges.isEmpty():
            break
        stars = materialise(_large_star(state, tasks).coalesce(tasks), "stars")
        state = materialise(_small_star(stars, tasks).coalesce(tasks), "edges")
    else:
        raise RuntimeError(f"components not settled after {max_rounds} rounds")
    members = state.select(F.col("u").alias("node"), F.col("v").alias("component"))
    names = members.select("component").distinct().select(F.col("component").alias("node"), "component")
    isolated = alone.distinct().select("node", F.col("node").alias("component")).join(
        members.select("node").union(names.select("node")), "node", "left_anti"
    )
    return members.union(names).union(isolated)
