"""Breadth-first search by frontier supersteps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import graph
from tessera.session import ensure_checkpoint_dir


def search(edges: DataFrame, root: int, root_again: bool = False) -> DataFrame:
    """v, level and parent of all vertices reached from the root (parent of the root: null).

    A vertex's parent is the smallest of those that reached it first.  With
    `root_again` the root is not taken as visited, so on a cycle it is found once more,
    with a level and a parent of its own.  The loop runs as long as vertices are
    found; each level is checkpointed, and only counts come to the driver.
    """
    spark = edges.sparkSession
    ensure_checkpoint_dir(spark)
    edges = edges.select("src", "dst").distinct().repartition("src").persist()  # one scan for all levels
    start = spark.range(root, root + 1).select(F.col("id").alias("v"), F.lit(0).alias("level"), F.lit(None).cast("long").alias("parent"))
    steps, frontier, level = [start], start, 0
    visited = start.where(F.lit(not root_again)).select("v")
    while True:
        level += 1
        found = graph.push(frontier.select("v"), edges, F.col("src").cast("long"), F.min).join(visited, "v", "left_anti")
        found = found.select("v", F.lit(level).alias("level"), F.col("value").alias("parent")).checkpoint()
        if found.isEmpty():
            break
        steps.append(found)
        frontier, visited = found, visited.unionAll(found.select("v"))
    out = steps[0]
    for s in steps[1:]:
        out = out.unionAll(s)
    return out


def level_sizes(reached: DataFrame) -> DataFrame:
    return reached.groupBy("level").agg(F.count("*").alias("n"))
