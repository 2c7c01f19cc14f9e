"""Operators over distributed arrays: map, reduce, statistics, repartition, local sort, top-k."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.session import ensure_checkpoint_dir


def array_map(df: DataFrame, **columns: Column) -> DataFrame:
    """One output row per input row, from column expressions."""
    return df.select(*(c.alias(name) for name, c in columns.items()))


def par_do(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Any function of a batch of rows to a batch of 0 or more rows (Arrow batches)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield fn(batch)

    return df.mapInPandas(run, schema)


def fold(df: DataFrame, zero: Callable[[], object], add: Callable[[object, dict], object], merge: Callable[[object, object], object], fan_in: int = 64) -> object:
    """A user's fold of all rows: each task folds its rows, then partial results (any picklable value) meet, `fan_in` at a time.

    add takes a partial result and a row; merge must be associative and commutative.
    An empty table gives zero().
    """

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        acc, some = zero(), False
        for batch in batches:
            for row in batch.to_dict("records"):
                acc, some = add(acc, row), True
        if some:
            yield pd.DataFrame({"acc": [pickle.dumps(acc)]})

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [pickle.loads(raw) for batch in batches for raw in batch["acc"]]
        if parts:
            yield pd.DataFrame({"acc": [pickle.dumps(reduce(merge, parts))]})

    ensure_checkpoint_dir(df.sparkSession)
    parts = df.mapInPandas(partial, "acc binary").checkpoint()
    while (n := parts.count()) > fan_in:
        parts = parts.repartition(-(-n // fan_in)).mapInPandas(meet, "acc binary").checkpoint()
    return reduce(merge, (pickle.loads(r["acc"]) for r in parts.collect()), zero())


def max_id(edges: DataFrame) -> DataFrame:
    return edges.agg(F.max(F.greatest("src", "dst")).cast("long").alias("max_id"))


def global_size(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("size"))


def checksum(edges: DataFrame) -> DataFrame:
    """Order-insensitive XOR of (src, dst) packed into 64 bits, src in the low half."""
    return edges.agg(F.bit_xor(F.col("src").cast("long") + F.shiftleft(F.col("dst").cast("long"), 32)).alias("checksum"))


def balance(df: DataFrame, part: Column) -> DataFrame:
    """Least, mean and most rows of a partition, and most / mean."""
    sizes = df.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    return sizes.agg(F.min("n").alias("min_rows"), F.avg("n").alias("avg_rows"), F.max("n").alias("max_rows"), (F.max("n") / F.avg("n")).alias("imbalance"))


def repartition_by(df: DataFrame, part: Column, parts: int) -> DataFrame:
    """Rows of a partition number together, with the number as column `part`."""
    return df.withColumn("part", part).repartition(parts, "part")


def sort_within(df: DataFrame, *keys: str) -> DataFrame:
    return df.sortWithinPartitions(*keys)


def top_k(counts: DataFrame, k: int, key: str = "word", count: str = "n") -> DataFrame:
    """The k largest counts; of equal counts the greater key stays."""
    return counts.orderBy(F.desc(count), F.desc(key)).limit(k)
