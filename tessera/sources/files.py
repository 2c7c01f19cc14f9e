"""File sources and sinks: text, binary records, fixed-width lines, config, persisted arrays, watched folders."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """One row, column value, for each line."""
    return spark.read.text(path)


def watch_text(spark: SparkSession, folder: str, files_per_trigger: int | None = None) -> DataFrame:
    """A stream of the lines of files that appear in a folder; each file is taken once.

    Files that are there at the start are taken too; the source's log, in the
    query's checkpoint, does the claiming.
    """
    reader = spark.readStream.schema("value string").format("text")
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).load(folder)


def write_text(lines: DataFrame, path: str, column: str = "value", mode: str = "error") -> None:
    lines.select(F.col(column).alias("value")).write.mode(mode).text(path)


#: Little-endian fields that a record can hold: bytes and signedness.
FIELDS = {"uint32": (4, False), "int32": (4, True), "uint64": (8, True), "int64": (8, True)}


def record_fields(record: Column, fields: Sequence[tuple[str, str]]) -> list[Column]:
    """Little-endian integers of a binary record, as longs (a uint64 above 2**63 comes out negative)."""
    out, at = [], 1
    for name, kind in fields:
        size, signed = FIELDS[kind]
        value = F.conv(_hex_reversed(record, at, size), 16, -10 if size == 8 else 10).cast("long")
        if size == 4 and signed:
            value = F.when(value >= 1 << 31, value - (1 << 32)).otherwise(value)
        out.append(value.alias(name))
        at += size
    return out


def _hex_reversed(record: Column, at: int, size: int) -> Column:
    return F.concat(*[F.hex(F.substring(record, at + i, 1)) for i in reversed(range(size))])


def read_binary_records(spark: SparkSession, path: str, fields: Sequence[tuple[str, str]], pad: int = 0) -> DataFrame:
    """Fixed-length records, and `pad` bytes behind each, of a file or folder of files, split among tasks; bytes of each file must fill records."""
    length = sum(FIELDS[kind][0] for _, kind in fields) + pad
    raw = spark.createDataFrame(spark.sparkContext.binaryRecords(path, length).map(lambda r: (bytearray(r),)), T.StructType([T.StructField("record", T.BinaryType())]))
    return raw.select(*record_fields(F.col("record"), fields))


def pack_records(df: DataFrame, fields: Sequence[tuple[str, str]]) -> DataFrame:
    """The inverse: one little-endian binary record a row."""
    parts = []
    for name, kind in fields:
        size = FIELDS[kind][0]
        digits = F.lpad(F.hex(F.col(name).cast("long").bitwiseAND(F.lit((1 << 32) - 1)) if size == 4 else F.col(name).cast("long")), 2 * size, "0")
        parts += [F.substring(digits, 2 * i + 1, 2) for i in reversed(range(size))]
    return df.select(F.unhex(F.concat(*parts)).alias("record"))


#: What follows each record that `write_binary_records` writes.
PAD = b"\n"


def write_binary_records(df: DataFrame, path: str, fields: Sequence[tuple[str, str]], mode: str = "error") -> None:
    """Packed records, each with a byte of padding behind it (the text sink's separator); read them with `pad=1`."""
    pack_records(df, fields).select(F.expr("string(record)").alias("value")).write.mode(mode).text(path)


def load_in_memory(spark: SparkSession, path: str) -> DataFrame:
    """A persisted array held by the executors; what does not fit in memory goes to their disks, a lost part is read again."""
    return load_array(spark, path).persist()


def fixed_width(value: Column, width: int) -> Column:
    """UTF-8 bytes of a line cut to `width`, or filled up with zero bytes."""
    return F.rpad(F.substring(F.encode(value, "UTF-8"), 1, width), width, F.lit(b"\x00"))


def read_config(spark: SparkSession, path: str) -> dict[str, str]:
    """A small file of `key = value` lines, on the driver."""
    rows = spark.read.text(path).select(F.split(F.trim("value"), r"\s*=\s*", 2).alias("p")).where(F.size("p") == 2).collect()
    return {r["p"][0]: r["p"][1] for r in rows}


def config_rows(lines: DataFrame) -> DataFrame:
    """key and value of `key = value` lines."""
    p = F.split(F.trim("value"), r"\s*=\s*", 2)
    return lines.where(F.size(p) == 2).select(F.get(p, F.lit(0)).alias("key"), F.get(p, F.lit(1)).alias("value"))


def persist_array(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").parquet(path)


def load_array(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
