"""PageRank as in the push form: un-normalised, alpha times incoming rank, fixed iterations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import graph
from tessera.session import ensure_checkpoint_dir

ALPHA = 0.15
CHECKPOINT_EVERY = 4


class Ranks:
    """The iteration's state: degrees are attached to the edges once, and the edges held by source.

    An iteration shuffles the ranks and the messages only.  Every fourth is checkpointed.
    """

    def __init__(self, vertices: DataFrame, edges: DataFrame, alpha: float, pull: bool = False):
        ensure_checkpoint_dir(edges.sparkSession)
        self.vertices, self.alpha, self.step = vertices, alpha, graph.pull if pull else graph.push
        degree = edges.groupBy("src").agg(F.count("*").alias("degree"))
        self.edges = edges.join(degree, "src").select("src", "dst", "degree").persist()
        self.now, self.done = vertices.select("v", F.lit(1.0 - alpha).alias("rank")), 0

    def advance(self, checkpoint: bool = False) -> DataFrame:
        got = self.step(self.now, self.edges, F.lit(self.alpha) * F.col("rank") / F.col("degree"), F.sum)
        after = self.vertices.join(got, "v", "left").select("v", (F.lit(1.0 - self.alpha) + F.coalesce("value", F.lit(0.0))).alias("rank"))
        self.done += 1
        self.now = after.checkpoint() if checkpoint or self.done % CHECKPOINT_EVERY == 0 else after
        return self.now


def ranks(vertices: DataFrame, edges: DataFrame, iterations: int, alpha: float = ALPHA, pull: bool = False) -> DataFrame:
    """v, rank after the iterations: rank = (1 - alpha) + sum over in-edges of alpha * rank(u) / outdegree(u).

    Starts from 1 - alpha.  Duplicate edges count each time; vertices without
    out-edges send nothing.  An iteration is one join along the edges and one
    aggregate with map-side combine.
    """
    state = Ranks(vertices, edges, alpha, pull)
    for _ in range(iterations):
        state.advance()
    return state.now


def sums(vertices: DataFrame, edges: DataFrame, iterations: int, alpha: float = ALPHA) -> DataFrame:
    """Per iteration, the sum of all ranks and that without isolated vertices; one row an iteration comes to the driver."""
    isolated = graph.isolated(vertices, edges).count()
    state, rows = Ranks(vertices, edges, alpha), []
    for i in range(1, iterations + 1):
        total = state.advance(checkpoint=True).agg(F.sum("rank")).first()[0] or 0.0
        rows.append((i, total, total - isolated * (1.0 - alpha)))
    return edges.sparkSession.createDataFrame(rows, "iteration int, total double, connected double")
