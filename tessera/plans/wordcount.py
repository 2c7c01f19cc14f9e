"""Word counts and top-k, batch and by window; streams use the same functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text


def lines(docs: DataFrame, column: str = "text") -> DataFrame:
    return docs.select(F.explode(text.split_lines(F.col(column))).alias("value"))


def words(lines_: DataFrame) -> DataFrame:
    return lines_.select(F.explode(text.split_words(F.col("value"))).alias("word"))


def counts(words_: DataFrame) -> DataFrame:
    return words_.groupBy("word").agg(F.count("*").alias("n"))


def top_by_window(keyed: DataFrame, k: int) -> DataFrame:
    """The k most frequent words of each window (columns wnid, word); the greater word first among equals."""
    n = keyed.groupBy("wnid", "word").agg(F.count("*").alias("n"))
    w = Window.partitionBy("wnid").orderBy(F.desc("n"), F.desc("word"))
    return n.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).drop("r")
