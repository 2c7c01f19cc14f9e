"""A corpus pipeline: quality, line dedup, near duplicates, decontamination, BPE.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and gives a
DataFrame, which is written as Parquet and read again as the next one's docs.  All
but the last return the columns of documents.

In every stage a null text is a text without words, lines or bytes; texts are taken
whole, whatever their length; rows are judged each on its own where they repeat,
save for near copies, of which one row stays; an empty table gives an empty one;
columns beyond those of documents are kept, but for the last stage.  Texts without
words go in the first stage.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, decontaminate, frames, linededup, quality, simjoin
from tessera.session import ensure_checkpoint_dir


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, trained on the weak labels of this input, keeps."""
    judged = quality.classify(docs, quality.train(docs), keep=docs.columns)
    return judged.where("keep").select(docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without recurring lines; one that consisted of such lines goes, its lines stand elsewhere."""
    kept = linededup.drop_recurring(docs)
    left = (F.col("n_dropped") == 0) | (F.trim(F.translate("text", "\n\t\r", "   ")) != "")
    return kept.where(left).withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text")).otherwise(F.col("n_chars")).cast("long")).select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, that of the smallest id, of each group linked by five-word Jaccard similarity 0.8 or more.

    Rows count by id and text: a null id comes after all others, of one id the smaller hash of the text stays, and of
    rows equal in both any one.  Rows without words are in no group and stay.
    """
    rows = docs.withColumn("__row", F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("text")))
    gone = frames.small(simjoin.components(rows, key="__row").where("__row <> component_id").select("__row").distinct())
    equal = rows.where(F.col("text").rlike("[^\\x20\\x09-\\x0D]")).groupBy("__row").agg(F.count("*").alias("n")).where("n > 1").select("__row")
    equal = frames.small(equal)
    left = rows.join(gone, "__row", "left_anti")
    once = left.join(equal, "__row", "left_semi").dropDuplicates(["__row"])
    return left.join(equal, "__row", "left_anti").unionByName(once).select(docs.columns)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokens of each document, and the digest of their decoding."""
    return bpe.round_trip(docs, bpe.default_path()).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256")
    )


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_quality),
    ("lines", drop_lines),
    ("near_copies", drop_near_copies),
    ("benchmark", drop_benchmark),
    ("tokens", to_tokens),
]

#: SQL cannot express the quality and near-copy stages; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each written to the shared folder and read again."""
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = None
    for i, (name, stage) in enumerate(STAGES):
        before, path = path, f"{folder}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:  # no later stage reads it
            gone = spark._jvm.org.apache.hadoop.fs.Path(before)
            gone.getFileSystem(spark._jsc.hadoopConfiguration()).delete(gone, True)
    return docs
