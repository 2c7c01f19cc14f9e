"""Language identification with hyperdimensional profiles.

Each letter has a random vector of +1 and -1.  A trigram's vector binds (multiplies)
the letters' vectors, permuted (rotated) by their place; a text's vector bundles
(adds) its trigrams' vectors, and a language's prototype bundles all its texts.
A text gets the language whose prototype has the highest cosine.

Letters are lower-cased; a-z have vectors of their own, other letters share 37 by
code point; any run of other characters is one boundary symbol.

Defined results: a null text, or one without letters, is `und` with score 0; ties
go to the language that sorts first; texts are profiled whole; without any
labelled text every text is `und`.  Rows with a null language teach nothing;
repeated rows teach each time and are judged alike; an empty table gives an empty
result; only `keep` columns are carried, and lang_pred and score win over kept ones
of the same name.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.frames import arrow_map
from tessera.llm.textops import as_binary, slices, stream64

DIMENSIONS, LETTERS, SHARPNESS = 1024, 64, 20.0


@lru_cache(maxsize=1)
def letter_codes() -> np.ndarray:
    """Symbol of each code point: 0 boundary, 1 to 26 a-z, 27 to 63 other letters."""
    out = np.array([27 + c % 37 if chr(c).isalpha() else 0 for c in range(0x110000)], dtype=np.uint8)
    out[97:123] = np.arange(1, 27)
    return out


@lru_cache(maxsize=2)
def letter_vectors(dimensions: int = DIMENSIONS) -> tuple[np.ndarray, ...]:
    """The letters' vectors, rotated by two, by one and not at all."""
    bits = np.unpackbits(stream64(LETTERS * dimensions // 64, 1717).view(np.uint8))
    v = (bits.reshape(LETTERS, dimensions).astype(np.int8) * 2) - 1
    return np.roll(v, 2, axis=1), np.roll(v, 1, axis=1), v


def gram_vectors(grams: np.ndarray, dimensions: int = DIMENSIONS) -> np.ndarray:
    first, second, third = letter_vectors(dimensions)
    return (first[grams >> 12] * second[grams >> 6 & 63] * third[grams & 63]).astype(np.float32)


def trigrams(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """(row, gram) of all trigrams whose middle is a letter."""
    points = [np.frombuffer(f" {t.lower()} ".encode("utf-32-le", "surrogatepass"), dtype=np.uint32) for t in texts]
    codes = letter_codes()[np.concatenate(points)].astype(np.int32)
    row = np.repeat(np.arange(len(texts)), [len(p) for p in points])
    keep = np.ones(len(codes), dtype=bool)
    keep[1:] = (codes[1:] > 0) | (codes[:-1] > 0) | (row[1:] != row[:-1])
    codes, row = codes[keep], row[keep]
    if len(codes) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int32)
    good = (row[2:] == row[:-2]) & (codes[1:-1] > 0)
    return row[2:][good], (codes[:-2] << 12 | codes[1:-1] << 6 | codes[2:])[good]


def profiles(rows: np.ndarray, grams: np.ndarray, n: int, dimensions: int = DIMENSIONS) -> np.ndarray:
    """Bundled vectors of n rows."""
    there = np.zeros(LETTERS**3, dtype=bool)
    there[grams] = True
    index = np.cumsum(there) - 1
    used = np.flatnonzero(there)
    counts = np.bincount(rows * len(used) + index[grams], minlength=n * len(used)).reshape(n, len(used)).astype(np.float32)
    return counts @ gram_vectors(used, dimensions)


def learn(labelled: DataFrame, text: str = "text", lang: str = "lang", dimensions: int = DIMENSIONS) -> dict[str, np.ndarray]:
    """Prototypes from all rows with a language; each task sends one vector a language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}

        def out() -> pa.RecordBatch:
            langs = sorted(sums)
            made = pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array([sums[x].tolist() for x in langs], pa.list_(pa.float64()))], ["lang", "vector"])
            sums.clear()
            return made

        for whole in batches:
            for batch in slices(whole, "text"):
                langs = batch.column("lang").to_pylist()
                names = sorted(set(langs))
                texts = [(b or b"").decode("utf-8", "replace") for b in as_binary(batch.column("text")).to_pylist()]
                rows, grams = trigrams(texts)
                if not len(rows):
                    continue
                of = np.array([names.index(x) for x in langs])
                # float32 holds these sums exactly below 2**24; counts are split by slice, sums kept in float64
                got = profiles(of[rows], grams, len(names), dimensions).astype(np.float64)
                for name, v in zip(names, got, strict=True):
                    sums[name] = sums.get(name, 0) + v
                if len(sums) > 500:
                    yield out()
        if sums:
            yield out()

    schema = T.StructType([T.StructField("lang", T.StringType()), T.StructField("vector", T.ArrayType(T.DoubleType()))])
    source = labelled.where(F.col(lang).isNotNull()).select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("binary").alias("text"))
    parts = arrow_map(source, run, schema).select("lang", F.posexplode("vector").alias("i", "x"))
    sums: dict[str, np.ndarray] = {}
    for r in parts.groupBy("lang", "i").agg(F.sum("x").alias("x")).collect():  # languages times dimensions
        sums.setdefault(r["lang"], np.zeros(dimensions))[r["i"]] = r["x"]
    return {k: v / n for k, v in sorted(sums.items()) if (n := float(np.linalg.norm(v))) > 0}


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], text: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """`keep` columns, lang_pred and score, the softmax of the cosines at the best language."""
    fields = [docs.schema[c] for c in keep if c not in ("lang_pred", "score")]
    names = [f.name for f in fields]
    schema = T.StructType([*fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    langs = sorted(prototypes)
    matrix = np.array([prototypes[x] for x in langs], dtype=np.float32) if langs else np.zeros((0, DIMENSIONS), np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "__text", 1 << 20, 384):
                n = batch.num_rows
                texts = [(b or b"").decode("utf-8", "replace") for b in as_binary(batch.column("__text")).to_pylist()]
                rows, grams = trigrams(texts)
                pred, score = ["und"] * n, [0.0] * n
                if len(rows) and langs:
                    seen = np.unique(rows)
                    at = np.searchsorted(seen, rows)
                    v = profiles(at, grams, len(seen), matrix.shape[1])
                    cosine = np.round((v @ matrix.T).astype(np.float64) / np.maximum(np.linalg.norm(v, axis=1), 1e-9)[:, None], 5)
                    weight = np.exp(SHARPNESS * (cosine - cosine.max(axis=1, keepdims=True)))
                    best = cosine.argmax(axis=1)
                    p = weight[np.arange(len(seen)), best] / weight.sum(axis=1)
                    for i, b, q in zip(seen.tolist(), best.tolist(), p.tolist(), strict=True):
                        pred[i], score[i] = langs[b], round(q, 6)
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(names))), pa.array(pred), pa.array(score, pa.float64())], [*names, "lang_pred", "score"])

    return arrow_map(docs.select(*(docs[c] for c in names), docs[text].cast("binary").alias("__text")), run, schema)


def held_out(doc_id: str = "doc_id"):
    """Whether crc32 of the id's text leaves 2 modulo 4; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))
