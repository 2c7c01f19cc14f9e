"""K-means with a fixed number of iterations."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import vectors

#: So many centre values go into an expression; with more, Arrow batches are compared as matrices.
EXPRESSION_VALUES = 2_000
Centres = list[list[float]]


def first_centres(points: DataFrame, k: int) -> Centres:
    """The k vectors of the smallest ids."""
    return [[float(v) for v in r["x"]] for r in points.orderBy("id").limit(k).collect()]


def nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lowest nearest centre, squared distance) of rows, centres in turn."""
    best, at = np.full(len(x), np.inf), np.zeros(len(x), dtype=np.int32)
    for i, c in enumerate(centres):
        d = ((x - c) ** 2).sum(axis=1)
        at[d < best] = i
        best = np.minimum(best, d)
    return at, best


def assign(points: DataFrame, centres: Centres) -> DataFrame:
    """Adds cluster and squared distance; of equal distances the lowest cluster."""
    if sum(map(len, centres)) <= EXPRESSION_VALUES:
        x = F.transform("x", lambda v: v.cast("double"))
        near = F.array_min(F.array(*[F.struct(vectors.squared_distance(x, vectors.literal(c)).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(centres)]))
        return points.withColumn("__n", near).select(*points.columns, F.col("__n.i").alias("cluster"), F.col("__n.d").alias("distance"))
    held = points.sparkSession.sparkContext.broadcast(np.array(centres))  # k * dim values, in the driver already

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                at, best = nearest(np.stack(batch["x"].to_numpy()).astype(float), held.value)
                yield batch.assign(cluster=at, distance=best)

    return points.mapInPandas(run, T.StructType([*points.schema.fields, T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.DoubleType())]))


def update(assigned: DataFrame, k: int, dim: int) -> Centres:
    """Means of the clusters; an empty cluster moves to the origin.

    A task sums its rows as vectors; k * dim values a task are shuffled, and k * dim
    come to the driver.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums, n = np.zeros((k, dim)), np.zeros(k, dtype=np.int64)
        for batch in batches:
            if len(batch):
                own = batch["cluster"].to_numpy()
                np.add.at(sums, own, np.stack(batch["x"].to_numpy()).astype(float))
                n += np.bincount(own, minlength=k)
        used = np.flatnonzero(n)
        yield pd.DataFrame({"cluster": np.repeat(used, dim), "pos": np.tile(np.arange(dim), len(used)), "s": sums[used].reshape(-1), "n": np.repeat(n[used], dim)})

    parts = assigned.select("cluster", "x").mapInPandas(run, "cluster int, pos int, s double, n long")
    out = [[0.0] * dim for _ in range(k)]
    for r in parts.groupBy("cluster", "pos").agg((F.sum("s") / F.sum("n")).alias("m")).collect():
        out[r["cluster"]][r["pos"]] = r["m"]
    return out


def train(points: DataFrame, k: int, iterations: int) -> tuple[Centres, Centres]:
    """(centres after the iterations, those that the last assignment used); points: id, x."""
    now = first_centres(points, k)
    dim = len(now[0]) if now else 0
    before = now
    for _ in range(iterations):
        before, now = now, update(assign(points, now), k, dim)
    return now, before


def cost(points: DataFrame, centres: Centres, marked_by: Centres) -> DataFrame:
    """Sum of squared distances to the updated centres of the last assignment's clusters."""
    marked = assign(points, marked_by)
    if sum(map(len, centres)) <= EXPRESSION_VALUES:
        x = F.transform("x", lambda v: v.cast("double"))
        own = F.get(F.array(*[vectors.literal(c) for c in centres]), F.col("cluster"))
        return marked.agg(F.sum(vectors.squared_distance(x, own)).alias("cost"))
    held = points.sparkSession.sparkContext.broadcast(np.array(centres))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                apart = np.stack(batch["x"].to_numpy()).astype(float) - held.value[batch["cluster"].to_numpy()]
                yield pd.DataFrame({"d": (apart**2).sum(axis=1)})

    return marked.select("x", "cluster").mapInPandas(run, "d double").agg(F.sum("d").alias("cost"))
