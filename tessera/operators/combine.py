"""User-defined combines: create, add, merge, extract; partial before the shuffle, merged after."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T


class CombineFn:
    """Override these; accumulators are any picklable value."""

    def create(self) -> Any:
        raise NotImplementedError

    def add(self, acc: Any, value: Any) -> Any:
        raise NotImplementedError

    def merge(self, a: Any, b: Any) -> Any:
        raise NotImplementedError

    def extract(self, acc: Any) -> Any:
        return acc


class SumCount(CombineFn):
    """Sum and count of a number."""

    def create(self):
        return (0.0, 0)

    def add(self, acc, value):
        return (acc[0] + value, acc[1] + 1)

    def merge(self, a, b):
        return (a[0] + b[0], a[1] + b[1])


def combine_per_key(df: DataFrame, key: str, value: str, fn: CombineFn, result: str, limit: int = 100_000) -> DataFrame:
    """One row a key: key and the fields of fn's result (`result`: their schema).

    A task keeps at most `limit` accumulators and passes them on when they are more,
    so memory is bounded; a key's partial accumulators meet after one shuffle.
    """
    key_field = df.schema[key]
    partial = T.StructType([key_field, T.StructField("acc", T.BinaryType())])
    schema = T.StructType([key_field, *T.StructType.fromDDL(result).fields])

    def before(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}

        def out() -> pd.DataFrame:
            frame = pd.DataFrame({key: list(held), "acc": [pickle.dumps(a) for a in held.values()]})
            held.clear()
            return frame

        for batch in batches:
            for k, v in zip(batch[key].tolist(), batch[value].tolist(), strict=True):
                held[k] = fn.add(held[k] if k in held else fn.create(), v)
            if len(held) > limit:
                yield out()
        if held:
            yield out()

    def after(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, acc, rows = None, None, []
        for batch in batches:
            for k, raw in zip(batch[key].tolist(), batch["acc"].tolist(), strict=True):
                one = pickle.loads(raw)
                if acc is not None and k == now:
                    acc = fn.merge(acc, one)
                else:
                    if acc is not None:
                        rows.append((now, *fn.extract(acc)))
                    now, acc = k, one
            if rows:
                yield pd.DataFrame(rows, columns=schema.names)
                rows = []
        if acc is not None:
            yield pd.DataFrame([(now, *fn.extract(acc))], columns=schema.names)

    moved = df.select(key, value).mapInPandas(before, partial).repartition(key).sortWithinPartitions(key)
    return moved.mapInPandas(after, schema)
