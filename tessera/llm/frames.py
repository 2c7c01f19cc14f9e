"""DataFrame helpers shared by the operators: size-checked broadcasts and Arrow maps that give memory back."""

from __future__ import annotations

import ctypes
import gc
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import textops

#: Most bytes of rows that a join broadcasts; larger sides are joined by shuffle.
BROADCAST_BYTES = 32 << 20
GIVE_BACK_SECONDS = 0.5
#: Arrow batches are cut by bytes, for texts may be long; a session's own setting stays.
BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def small(df: DataFrame, row_bytes: Column | int = 32) -> DataFrame:
    """The rows computed once, and broadcast if their bytes are few; else left to a shuffled join."""
    held = df.checkpoint()
    size = held.agg(F.sum(F.lit(row_bytes).cast("long") if isinstance(row_bytes, int) else row_bytes)).first()[0] or 0
    return F.broadcast(held) if size <= BROADCAST_BYTES else held


def release(spark: SparkSession) -> None:
    """Lets the driver find the shuffle and checkpoint files of finished phases, so that they go now and not at some later collection.

    py4j gives up the Java objects of collected Python ones about a second later; those that wait are given up here, or
    the collection would still find them in use.
    """
    gc.collect()
    waiting = getattr(spark.sparkContext._gateway._gateway_client, "finalizer_deque", None)
    while waiting:
        try:
            client, target = waiting.pop()
        except IndexError:  # py4j's own thread took the last
            break
        client.garbage_collect_object(target, False)
    time.sleep(0.05)  # what py4j's own thread has just taken
    spark.sparkContext._jvm.System.gc()


def give_back() -> None:
    """Returns unused memory of this worker to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def packed_checkpoint(df: DataFrame) -> DataFrame:
    """The rows computed once, a checkpoint of compressed Arrow batches; a checkpoint of rows takes several times that on disk."""
    schema = df.schema

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                    out.write_batch(batch)
                yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["packed"])

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for one in batch.column("packed"):
                yield from pa.ipc.open_stream(one.as_buffer())

    return arrow_map(arrow_map(df, pack, "packed binary").checkpoint(), unpack, schema)


def arrow_map(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType | str) -> DataFrame:
    """mapInArrow over batches of bounded size, with unused memory given back now and then and after a task.

    Workers live on beside the next stage's, and so does what they keep.
    """
    if df.sparkSession.conf.get(BATCH_SETTING, None) is None:
        df.sparkSession.conf.set(BATCH_SETTING, str(BATCH_BYTES))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = time.monotonic()
        try:
            for batch in run(batches):
                yield batch
                if time.monotonic() - last > GIVE_BACK_SECONDS:
                    give_back()
                    last = time.monotonic()
        finally:
            textops.forget()
            gc.collect()
            give_back()

    return df.mapInArrow(task, schema)
