"""A small builder API: a pipeline of transforms over batch or streaming DataFrames."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import windows
from tessera.operators.combine import CombineFn, combine_per_key

Transform = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class PCollection:
    """Rows of one schema, bounded or not; transforms give new collections."""

    df: DataFrame

    def apply(self, transform: Transform) -> PCollection:
        return PCollection(transform(self.df))

    def write(self, sink: Callable[[DataFrame], object]) -> object:
        return sink(self.df)


class Pipeline:
    """The root: applies a source, and runs a stream until its input is used up or for good."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def apply(self, source: Callable[[SparkSession], DataFrame]) -> PCollection:
        return PCollection(source(self.spark))

    def run(self, collection: PCollection, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append", every: str | None = None):
        """Starts the stream into foreachBatch; `every` bounds latency, without it all input is taken once and the query ends."""
        writer = collection.df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(sink)
        return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


class DoFn:
    """A function of one element to any number of outputs; no state between elements."""

    schema = ""

    def process(self, row: dict) -> Iterator[tuple]:
        raise NotImplementedError


class ParDo:
    @staticmethod
    def of(fn: DoFn) -> Transform:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            names = [x.split()[0] for x in fn.schema.split(",")]
            for batch in batches:
                rows = [out for row in batch.to_dict("records") for out in fn.process(row)]
                yield pd.DataFrame(rows, columns=names)

        return lambda df: df.mapInPandas(run, fn.schema)

    @staticmethod
    def expr(*columns) -> Transform:
        """The same for column expressions: no Python per row."""
        return lambda df: df.select(*columns)


class FixedWindows:
    @staticmethod
    def assign(ts: str, size_us: int) -> Transform:
        return lambda df: df.withColumn("wnid", windows.fixed_window(windows.micros(F.col(ts)), size_us))


class WindowedCombine:
    @staticmethod
    def globally(*aggregates) -> Transform:
        return lambda df: df.groupBy("wnid").agg(*aggregates)

    @staticmethod
    def per_key(key: str, *aggregates) -> Transform:
        return lambda df: df.groupBy("wnid", key).agg(*aggregates)

    @staticmethod
    def with_fn(fn: CombineFn, value: str, result: str) -> Transform:
        """A user-defined combine of each window (bounded collections)."""
        return lambda df: combine_per_key(df, "wnid", value, fn, result)


class Shuffle:
    @staticmethod
    def by_window(tasks: int) -> Transform:
        return lambda df: df.repartition(tasks, F.pmod("wnid", F.lit(tasks)))
