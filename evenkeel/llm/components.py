"""Connected components by alternating large-star and small-star steps, on DataFrames throughout."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenkeel.llm.common import durable

#: Links that a task is given; steps on fewer links use fewer tasks, whatever the session's number of shuffle partitions.
LINKS_A_TASK = 100_000


def components(links: DataFrame) -> DataFrame:
    """``node, component`` (its least node) for every node of the links ``a, b``.

    Every step replaces each node's links by links to its least neighbour, so a component's
    diameter shrinks fast; it ends when a step changes nothing.  Loops and repeats are harmless.
    """
    edges = durable(links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = _state(edges)
    while state[0]:
        tasks = 1 + state[0] // LINKS_A_TASK
        edges = durable(_small_star(_large_star(edges.coalesce(tasks)).coalesce(tasks)).coalesce(tasks))
        now = _state(edges)
        if now == state:
            break
        state = now
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return nodes.unionByName(roots)


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node links its larger neighbours to the least of its neighbours and itself."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node links its smaller neighbours and itself to the least of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b")
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()
