"""The registered queries of this subpackage: thin wrappers that derive the digest columns of each operator's result."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, decontaminate, langid, linededup, oracles, pii, quality, simjoin, suffix, urls, webp


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"), bpe.default_path()).select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op1_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = linededup.drop_recurring(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op2_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix.repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", langid.held_out())
    prototypes = langid.learn(docs.where("not held_out"))
    return langid.predict(docs, prototypes, keep=("doc_id", "held_out"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.classify(docs, quality.train(docs))


def op7_partenum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simjoin.components(table(spark, sf_dir, "documents").select("doc_id", "text"), n=3, p=90, q=100)


def op8_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = webp.to_media(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return webp.read_media(media)


#: (verdict, host and path prefix) of the URL query.
URL_RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))


def op9_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = urls.judge(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["base"])
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    of = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    counts = [of(k) for k in pii.BASE_KINDS]
    whole = [F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans")]
    return found.select("doc_id", *counts, *whole)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


def media_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op8_webp that SQL can state."""
    return op8_webp(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256")


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op9_urls that SQL can state."""
    return op9_urls(spark, sf_dir).select("page_id", "host", "path", "rule")


def pii_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op10_pii that SQL can state."""
    return op10_pii(spark, sf_dir).select("doc_id", *(f"n_{k}" for k in pii.BASE_KINDS))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_lines": op1_lines,
    "op2_suffix": op2_suffix,
    "op3_decontaminate": op3_decontaminate,
    "op4_bpe": op4_bpe,
    "op5_langid": op5_langid,
    "op6_quality": op6_quality,
    "op7_partenum": op7_partenum,
    "op8_webp": op8_webp,
    "op9_urls": op9_urls,
    "op10_pii": op10_pii,
    "pipeline": pipeline,
    "media_payloads": media_payloads,
    "url_rules": url_rules,
    "pii_counts": pii_counts,
}
ORACLE_SQL: dict[str, str] = oracles.ORACLE_SQL | {"url_rules": oracles.url_rules(URL_RULES)}
