"""Tumbling windows, windowed combines and the slot rule for late rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import ids

SLOTS = 3


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a wall-clock timestamp (NTZ) taken as UTC, whatever the session's zone."""
    return F.unix_micros(F.from_utc_timestamp(ts.cast("timestamp"), F.current_timezone()))


def fixed_window(at: Column, size: int) -> Column:
    """Number of the window of `size` units that holds `at`."""
    whole, n = at.cast("long"), F.lit(size).cast("long")
    return ids.whole(whole - F.pmod(whole, n), size)  # in integers, also before 1970


def sum_count(df: DataFrame, value: str = "value", keys: tuple[str, ...] = ("wnid",)) -> DataFrame:
    return df.groupBy(*keys).agg(F.sum(value).alias("total"), F.count("*").alias("n"))


def keep_on_time(df: DataFrame, arrival: str, tie: str, tasks: int = 1, chunk: int = 65_536) -> DataFrame:
    """Drops late rows by the slot rule; needs columns wnid, `arrival` (long) and `tie`.

    A task holds one open window in each of three slots (wnid modulo 3); a later
    window of the slot closes the one before, and rows of a closed window are
    dropped.  So a row stays if no row that arrived earlier at its task and slot has
    a greater window.  The running maximum is taken in chunks of arrival numbers:
    each chunk's maximum first, then those of the chunks before, then within the
    chunk, so that no task needs all rows of a slot.
    """
    keyed = df.withColumns({"__task": F.pmod("wnid", F.lit(tasks)), "__slot": F.pmod("wnid", F.lit(SLOTS)), "__chunk": fixed_window(F.col(arrival), chunk)})
    keys = ["__task", "__slot", "__chunk"]
    tops = keyed.groupBy(*keys).agg(F.max("wnid").alias("__top"))
    before = Window.partitionBy("__task", "__slot").orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select(*keys, F.max("__top").over(before).alias("__before"))
    within = Window.partitionBy(*keys).orderBy(arrival, tie).rowsBetween(Window.unboundedPreceding, -1)
    placed = keyed.join(tops, keys).withColumn("__max", F.greatest("__before", F.max("wnid").over(within)))
    return placed.where(F.col("__max").isNull() | (F.col("__max") <= F.col("wnid"))).select(df.columns)
