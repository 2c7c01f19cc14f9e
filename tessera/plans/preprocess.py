"""Graph preprocessing: scan, remap, repartition, sort, adjacency, validation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import ids
from tessera.operators import arrays, graph


def remap(edges: DataFrame, mapping) -> DataFrame:
    """Both ends through a function of an id column."""
    return edges.select(mapping(F.col("src")).alias("src"), mapping(F.col("dst")).alias("dst"))


def prepare(edges: DataFrame, parts: int, mapping) -> tuple[DataFrame, DataFrame]:
    """(edges by partition, sorted within; prefix index)."""
    moved = arrays.repartition_by(remap(edges, mapping), ids.part_of(F.col("src")), parts)
    return arrays.sort_within(moved, "part", "src", "dst"), graph.csr_index(moved)


def validate(before: DataFrame, after: DataFrame) -> bool:
    """Whether a move kept the number of edges and their checksum."""
    facts = [(df.agg(F.count("*")).first()[0], arrays.checksum(df).first()[0]) for df in (before, after)]
    return facts[0] == facts[1]


def write(sorted_edges: DataFrame, index: DataFrame, path: str) -> None:
    sorted_edges.write.mode("overwrite").partitionBy("part").parquet(f"{path}/edges")
    index.write.mode("overwrite").partitionBy("part").parquet(f"{path}/index")


def owner(vid: Column, bounds: Sequence[int]) -> Column:
    """The partition that owns a vertex by ranges: partition i holds ids from bounds[i] up to, not including, bounds[i + 1]."""
    return F.aggregate(F.array(*[F.lit(b).cast("long") for b in bounds[1:-1]]) if len(bounds) > 2 else F.array().cast("array<long>"), F.lit(0), lambda n, b: n + (vid >= b).cast("int"))


def equal_edge_bounds(edges: DataFrame, vertices: int, parts: int) -> list[int]:
    """Bounds of ranges of consecutive vertices with about equal numbers of out-edges; only the bounds come to the driver.

    A range begins at the first vertex before which there are at least its share of
    the edges: a heavy vertex is not split.
    """
    total = edges.count()
    degree = edges.groupBy(F.col("src").alias("v")).agg(F.count("*").alias("d")).withColumn("all", F.lit(0))
    before = graph.running(degree, "all", "v", "d", "before")
    share = F.call_function("div", F.col("before") * parts, F.lit(max(total, 1)).cast("long"))
    first = {r["part"]: r["v"] for r in before.groupBy(share.alias("part")).agg(F.min("v").alias("v")).collect()}
    bounds = [0]
    for i in range(1, parts):
        later = [v for p, v in first.items() if p >= i]
        bounds.append(max(bounds[-1], min(later, default=vertices)))
    return [*bounds, vertices]
