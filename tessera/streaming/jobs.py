"""Streaming jobs over Parquet or text folders: word counts, windowed sums, slots with state."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.operators import arrays, windows
from tessera.plans import wordcount
from tessera.sources import files
from tessera.session import ensure_checkpoint_dir
from tessera.streaming.pipeline import PCollection, Pipeline


def work_folder(spark: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark)}/stream-{name}-{uuid.uuid4().hex}"


def stream_of(spark: SparkSession, path: str, files_per_trigger: int = 8) -> DataFrame:
    """A stream of a Parquet file or folder, with the schema of what is there now.

    The path is given as a pattern that only it matches: a plain path must be a folder.
    """
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_trigger).parquet(f"{path[:-1]}[{path[-1]}]")


def run_to_end(spark: SparkSession, df: DataFrame, name: str, mode: str, sink: Callable[[DataFrame, int, str], None], every: str | None = None) -> str:
    """Runs over all available input; the sink writes each batch under the returned folder.

    With `every` the batches come at that interval, and the query is stopped once it has taken what is there.
    """
    folder = work_folder(spark, name)
    query = Pipeline(spark).run(PCollection(df), lambda batch, i: sink(batch, i, folder), f"{folder}/checkpoint", mode, every)
    if every:
        query.processAllAvailable()
        query.stop()
    query.awaitTermination()
    return folder


def _replace(batch: DataFrame, i: int, folder: str) -> None:
    batch.write.mode("overwrite").parquet(f"{folder}/batch={i}")


def _last(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of the last batch (complete mode repeats the whole result in each)."""
    every = spark.read.option("basePath", folder).parquet(f"{folder}/batch=*")
    last = every.agg(F.max("batch").alias("last"))
    return every.join(last, every["batch"] == last["last"]).drop("batch", "last")


def word_top_k(spark: SparkSession, path: str, k: int) -> DataFrame:
    """Cumulative word counts of a stream of documents; the top k after the last batch."""
    counts = wordcount.counts(wordcount.words(wordcount.lines(stream_of(spark, path))))
    folder = run_to_end(spark, counts, "words", "complete", lambda b, i, f: _replace(arrays.top_k(b, k), i, f))
    return _last(spark, folder)


def window_sums(spark: SparkSession, path: str, size_us: int, every: str | None = None) -> DataFrame:
    """Sum and count of each window of a stream of events, end of stream included; `every` bounds the latency of its batches."""
    events = stream_of(spark, path).withColumn("wnid", windows.fixed_window(windows.micros(F.col("ts")), size_us))
    folder = run_to_end(spark, windows.sum_count(events), "sums", "complete", _replace, every)
    return _last(spark, folder)


def watched_words(spark: SparkSession, folder: str, files_per_trigger: int) -> DataFrame:
    """Counts of the words of all files of a watched folder, some files a batch."""
    counts = wordcount.counts(wordcount.words(files.watch_text(spark, folder, files_per_trigger)))
    return _last(spark, run_to_end(spark, counts, "watch", "complete", _replace))


SLOT_OUT = "wnid long, total double, n long"


def slot_sums(arrivals: DataFrame, tasks: int = 1) -> DataFrame:
    """Windowed sums with state: one open window in each (task, slot), late rows dropped.

    arrivals: wnid, value, arrival (the order within a batch) and tie.  Rows of a later
    batch arrive after all of those before, whatever their arrival number.  Each
    batch gives the windows it closed and the open ones so far; of a window's rows
    the one with the greatest n is final.  A (task, slot) is sorted in one task: give
    as many tasks as windows allow, and batches that fit.
    """

    def step(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        now = list(state.get) if state.exists else None
        rows = pd.concat(list(frames)).sort_values(["arrival", "tie"])
        out = []
        for w, v in zip(rows["wnid"].tolist(), rows["value"].tolist(), strict=True):
            if now is None or w > now[0]:
                if now is not None:
                    out.append(tuple(now))
                now = [w, 0.0, 0]
            if w == now[0]:
                now = [w, now[1] + v, now[2] + 1]
        state.update(tuple(now))
        yield pd.DataFrame([*out, tuple(now)], columns=["wnid", "total", "n"])

    keyed = arrivals.withColumns({"task": F.pmod("wnid", F.lit(tasks)), "slot": F.pmod("wnid", F.lit(windows.SLOTS))})
    return keyed.groupBy("task", "slot").applyInPandasWithState(step, SLOT_OUT, SLOT_OUT, "update", "NoTimeout")


def stateful_window_sums(spark: SparkSession, arrivals: DataFrame, tasks: int = 1) -> DataFrame:
    folder = run_to_end(spark, slot_sums(arrivals, tasks), "slots", "update", _replace)
    every = spark.read.option("basePath", folder).parquet(f"{folder}/batch=*")
    return every.groupBy("wnid").agg(F.max_by("total", "n").alias("total"), F.max("n").alias("n"))


def throughput(query: StreamingQuery, seconds: float = 1.0) -> Iterator[float]:
    """Input rows a second of a running query, every so often."""
    while query.isActive:
        time.sleep(seconds)
        last = query.lastProgress
        if last:
            yield float(last["processedRowsPerSecond"] or 0)


def print_top_k(k: int) -> Callable[[DataFrame, int], None]:
    """A console sink for foreachBatch: the top k, ascending, with the totals."""

    def sink(batch: DataFrame, i: int) -> None:
        total = batch.agg(F.sum("n")).first()[0] or 0
        print(f"batch {i}: {total} words")
        for r in reversed(arrays.top_k(batch, k).collect()):
            print(f"  {r['word']}: {r['n']}")

    return sink
