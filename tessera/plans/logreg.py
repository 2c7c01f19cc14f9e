"""Logistic regression by full-batch steps: summed gradients, no intercept, zero start."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import vectors

RATE = 0.1


def train(rows: DataFrame, dim: int, iterations: int, rate: float = RATE) -> list[float]:
    """Weights; rows: x (array) and y (0 or 1).  A task sums its gradient; one value a dimension and task is shuffled."""
    w = np.zeros(dim)
    for _ in range(iterations):
        now = w.copy()

        def run(batches: Iterator[pd.DataFrame], now: np.ndarray = now) -> Iterator[pd.DataFrame]:
            g = np.zeros(dim)
            for batch in batches:
                if len(batch):
                    x = np.stack(batch["x"].to_numpy()).astype(float)
                    g += (1.0 / (1.0 + np.exp(-(x @ now))) - batch["y"].to_numpy()) @ x
            yield pd.DataFrame({"pos": np.arange(dim), "g": g})

        parts = rows.select("x", "y").mapInPandas(run, "pos int, g double")
        for r in parts.groupBy("pos").agg(F.sum("g").alias("g")).collect():
            w[r["pos"]] -= rate * r["g"]
    return w.tolist()


def predict(rows: DataFrame, w: list[float]) -> DataFrame:
    """Adds p and pred, 1 from a probability of one half."""
    x = F.transform("x", lambda v: v.cast("double"))
    p = vectors.sigmoid(vectors.dot(x, vectors.literal(w)))
    return rows.withColumn("p", p).withColumn("pred", (F.col("p") >= 0.5).cast("int"))


def accuracy(predicted: DataFrame) -> DataFrame:
    return predicted.agg(F.avg((F.col("pred") == F.col("y")).cast("double")).alias("accuracy"))
