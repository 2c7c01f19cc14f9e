"""Generators: the MMIX linear congruential sequence of doubles, and random dictionary words."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

# Multiplier and increment of the MMIX generator, and the built-in dictionary.
MULTIPLIER = 6364136223846793005
INCREMENT = 1442695040888963407
DICTIONARY = (
    "yuppies yuppy yups z zanier zanies zaniest zaniness zany zap zapped zapping zaps zeal zealot zealots zealous zealously zealousness "
    "zebra zebras zebu zebus zed zeds zenith zeniths zephyr zephyrs zeppelin zeppelins zero zeroed zeroes zeroing zeros zest zestful zestfully zests zeta zigzag"
).split()


def states(instance: np.ndarray, step: np.ndarray) -> np.ndarray:
    """State after `step` + 1 steps of each instance's sequence, by doubling of the affine map (modulo 2**64)."""
    a, c = np.uint64(MULTIPLIER), np.uint64(INCREMENT)
    state = instance.astype(np.uint64) + c
    left = step.astype(np.uint64) + np.uint64(1)
    with np.errstate(over="ignore"):
        while left.any():
            odd = (left & np.uint64(1)).astype(bool)
            state[odd] = state[odd] * a + c
            c = c * (a + np.uint64(1))
            a = a * a
            left = left >> np.uint64(1)
    return state


def to_double(state: np.ndarray, low: float, high: float) -> np.ndarray:
    return (high - low) * ((state & np.uint64(0xFFFFFFFF)).astype(np.float64) / 0xFFFFFFFF) + low


def lcg_doubles(spark: SparkSession, instances: int, n: int, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """instance, i and the i-th double of each instance's sequence; any row is found without those before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = batch.column("id").to_numpy()
            instance, i = k // n, k % n
            yield pa.RecordBatch.from_arrays([pa.array(instance), pa.array(i), pa.array(to_double(states(instance, i), low, high))], ["instance", "i", "v"])

    return spark.range(instances * n).mapInArrow(run, "instance long, i long, v double")


def generate(spark: SparkSession, fn: Callable[[int], Iterator[tuple]], schema: str, instances: int) -> DataFrame:
    """Rows of a user's generator function, called once for each instance number, instances side by side."""
    names = T.StructType.fromDDL(schema).names

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k in batch["id"]:
                rows = fn(int(k))
                while some := list(islice(rows, 10_000)):
                    yield pd.DataFrame(some, columns=names)

    return spark.range(0, instances, 1, instances).mapInPandas(run, schema)


def random_word(key: Column, seed: int = 0, words: tuple[str, ...] | list[str] = DICTIONARY) -> Column:
    """A dictionary word for each key, about uniform: the high bits of a multiplicative hash."""
    mixed = ((key.cast("long") + 1) * F.lit(2654435761) + F.lit(seed * 40503)) % F.lit(1 << 32)
    at = (F.shiftright(mixed, 8) % F.lit(len(words))).cast("int")
    return F.get(F.array(*[F.lit(w) for w in words]), at)


def dictionary(lines: DataFrame) -> DataFrame:
    """Words of a white-space-separated file, column value."""
    return lines.select(F.explode(F.split(F.trim("value"), r"\s+")).alias("word")).where("word <> ''")


class _Range(InputPartition):
    def __init__(self, instance: int, start: int, end: int):
        self.instance, self.start, self.end = instance, start, end


class _Batch(DataSourceReader):
    def __init__(self, options: dict):
        self.instances, self.n = int(options.get("instances", 1)), int(options.get("rows", 1000))

    def partitions(self):
        return [_Range(i, 0, self.n) for i in range(self.instances)]

    def read(self, partition):
        i = np.arange(partition.start, partition.end)
        v = to_double(states(np.full(len(i), partition.instance), i), 0.0, 1.0)
        yield from zip([partition.instance] * len(i), i.tolist(), v.tolist(), strict=True)


class _Stream(SimpleDataSourceStreamReader):
    """Each trigger takes the next `rowsPerBatch` doubles."""

    def __init__(self, options: dict):
        self.instance, self.n = int(options.get("instance", 0)), int(options.get("rowsPerBatch", 100))

    def initialOffset(self):
        return {"i": 0}

    def _rows(self, start: int, end: int):
        i = np.arange(start, end)
        return iter(list(zip([self.instance] * len(i), i.tolist(), to_double(states(np.full(len(i), self.instance), i), 0.0, 1.0).tolist(), strict=True)))

    def read(self, start):
        return self._rows(start["i"], start["i"] + self.n), {"i": start["i"] + self.n}

    def readBetweenOffsets(self, start, end):
        return self._rows(start["i"], end["i"])

    def commit(self, end):
        pass


class LcgSource(DataSource):
    """`spark.dataSource.register(LcgSource)`, then format("lcg"): batch, or an unbounded stream."""

    @classmethod
    def name(cls) -> str:
        return "lcg"

    def schema(self) -> str:
        return "instance long, i long, v double"

    def reader(self, schema):
        return _Batch(self.options)

    def simpleStreamReader(self, schema):
        return _Stream(self.options)
