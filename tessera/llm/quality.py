"""Quality classifier from weak labels.

Overlapping heuristic labellers look at each document.  Counts of their vote
patterns over all documents (at most 2**labellers rows) go through expectation
maximisation for a two-class model, which estimates how often each labeller
fires on junk and on clean text, hence each pattern's posterior.  The posteriors
label a bounded sample (`TRAIN_ROWS`, chosen by a hash of the id) that trains a
linear scorer on hashed word shapes; the scorer judges every whole document.

Defined results: a null text is the empty text, and without words a document is
rejected with score 0; repeated rows are judged alike, and no score depends on a
row's neighbours; rows that tie at the edge of the training sample have one text, so
any of them will do; an empty table gives an empty result; texts of any length are
measured whole; only `keep` columns are carried, and the made ones win over kept
ones of the same name.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.frames import arrow_map
from tessera.llm.textops import U64, Words, buffers, mix64, slices

#: Most rows that the linear scorer is fitted on, and its hashed features.
TRAIN_ROWS, FEATURES = 6000, 2048

CLASS = np.full(256, 3, dtype=np.uint8)  # 0 lower, 1 upper, 2 digit, 3 symbol, 4 beyond ASCII
CLASS[97:123], CLASS[65:91], CLASS[48:58], CLASS[128:] = 0, 1, 2, 4
STOP = np.zeros(256, dtype=bool)
STOP[list(b".,;:?\"')")] = True  # marks that end words in prose

LABELLERS = ("repeats", "few_words", "symbols", "odd_ends", "capitals", "bars", "long_words", "no_stops", "prose")


def measures(words: Words, raw: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """Per-row shares of words (or bytes) with a trait."""
    n_rows, n = len(offsets) - 1, np.maximum(words.count, 1)
    total = lambda flag: np.bincount(words.row, weights=flag, minlength=n_rows)
    per_byte = np.maximum(np.diff(offsets), 1)

    def in_bytes(flag: np.ndarray) -> np.ndarray:
        c = np.concatenate(([0], np.cumsum(flag)))
        return (c[offsets[1:]] - c[offsets[:-1]]) / per_byte

    size = words.end - words.start
    last = raw[words.end - 1] if len(size) else np.zeros(0, np.uint8)
    same = np.zeros(len(size), dtype=bool)
    if len(size):
        same[1:] = (words.hash[1:] == words.hash[:-1]) & (words.row[1:] == words.row[:-1])
    order = np.lexsort((words.hash, words.row))
    h, r = words.hash[order], words.row[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    kind = CLASS[raw]
    return {
        "words": words.count.astype(float),
        "same": total(same) / n,
        "distinct": np.bincount(r[new], minlength=n_rows) / n,
        "symbols": in_bytes((kind == 3) & (raw > 32) & ~STOP[raw]),
        "upper": in_bytes(kind == 1) / np.maximum(in_bytes((kind == 0) | (kind == 1)), 1e-9),
        "odd_ends": total((CLASS[last] == 3) & ~STOP[last]) / n,
        "bars": total((size == 1) & (last == ord("|"))) / n,
        "long": total(size > 24) / n,
        "stops": total(STOP[last]) / n,
    }


def votes(m: dict[str, np.ndarray]) -> np.ndarray:
    """Bit pattern of the labellers that fire; the last one speaks for clean text."""
    long = m["words"] >= 40
    junk = [
        (m["same"] > 0.08) & (m["same"] * m["words"] >= 4),
        long & (m["distinct"] < 0.55 - 0.07 * np.log10(np.maximum(m["words"], 1))),
        m["symbols"] > 0.06,
        m["odd_ends"] > 0.12,
        m["upper"] > 0.35,
        m["bars"] > 0.08,
        m["long"] > 0.05,
        long & (m["stops"] < 0.01),
    ]
    prose = (m["same"] < 0.03) & (m["symbols"] < 0.03) & (m["upper"] < 0.25) & (m["stops"] > 0.01)
    return sum(f.astype(np.int64) << i for i, f in enumerate([*junk, prose]))


def shape_features(words: Words, raw: np.ndarray, n_rows: int, m: dict[str, np.ndarray]) -> np.ndarray:
    """Dense rows of hashed features: word shapes, pairs of shapes, and binned measures, as root shares."""
    out = np.zeros((n_rows, FEATURES), dtype=np.float32)
    if len(words.start):
        first, last, size = raw[words.start], raw[words.end - 1], words.end - words.start
        inner = CLASS[raw[words.start + size // 2]]
        end = np.where(CLASS[last] == 3, last.astype(np.int64), 256 + CLASS[last].astype(np.int64))
        shape = ((CLASS[first].astype(np.int64) * 5 + inner) * 512 + end) * 8 + np.minimum(size // 4, 7)
        same = np.zeros(len(size), dtype=np.int64)
        same[1:] = (words.hash[1:] == words.hash[:-1]) & (words.row[1:] == words.row[:-1])
        n = np.maximum(words.count, 1).astype(np.float32)
        pair = np.flatnonzero(words.row[1:] == words.row[:-1]) + 1  # second words of pairs, none across rows
        for kind, code, row in ((1, shape, words.row), (2, shape[pair] * 131_071 + shape[pair - 1], words.row[pair]), (3, same, words.row)):
            bucket = (mix64((code.astype(U64) << U64(3)) + U64(kind)) % U64(FEATURES)).astype(np.int64)
            share = np.bincount(row * FEATURES + bucket, minlength=n_rows * FEATURES).reshape(n_rows, FEATURES) / n[:, None]
            out += np.sqrt(share).astype(np.float32)
    for i, key in enumerate(("same", "distinct", "symbols", "upper", "odd_ends", "bars", "long", "stops")):
        binned = np.minimum((np.sqrt(m[key]) * 12).astype(np.int64), 12)
        out[np.arange(n_rows), (mix64((binned + 64 * i).astype(U64) * U64(8) + U64(5)) % U64(FEATURES)).astype(np.int64)] += 1
    return out


def fit_labels(patterns: dict[int, int], steps: int = 200) -> tuple[dict[int, float], np.ndarray]:
    """Posterior of junk for each vote pattern, and each labeller's firing rate on clean and junk text.

    Starts from patterns with a firing junk labeller as likely junk; labellers are
    taken as independent within a class; rates are smoothed by one vote each way.
    """
    keys = sorted(patterns)
    k = len(LABELLERS)
    fired = np.array([[p >> i & 1 for i in range(k)] for p in keys], dtype=float).reshape(len(keys), k)
    n = np.array([patterns[p] for p in keys], dtype=float)
    junk = np.where(fired[:, :-1].sum(axis=1) > fired[:, -1], 0.9, 0.05)
    rates = np.full((2, k), 0.5)
    for _ in range(steps if len(keys) else 0):
        weight = np.stack([n * (1 - junk), n * junk])
        prior = np.clip((weight.sum(axis=1) + 1) / (n.sum() + 2), 1e-3, 1 - 1e-3)
        rates = (weight @ fired + 1) / (weight.sum(axis=1, keepdims=True) + 2)
        like = fired @ np.log(rates.T) + (1 - fired) @ np.log(1 - rates.T) + np.log(prior)
        after = 1 / (1 + np.exp(np.clip(like[:, 0] - like[:, 1], -50, 50)))
        if np.abs(after - junk).max() < 1e-9:
            break
        junk = after
    return dict(zip(keys, junk.tolist(), strict=True)), rates


def fit_linear(x: np.ndarray, y: np.ndarray, steps: int = 150, l2: float = 1e-4) -> np.ndarray:
    """Weights and intercept of a logistic scorer on soft labels (Nesterov steps, full batches)."""
    n, d = x.shape
    w, v = np.zeros(d + 1), np.zeros(d + 1)
    rate = 4.0 / (1 + float(np.einsum("ij,ij->", x, x) / n if n else 0))
    for t in range(steps if n else 0):
        ahead = w + t / (t + 3) * (w - v)
        p = 1 / (1 + np.exp(-np.clip((x @ ahead[:-1].astype(x.dtype)).astype(float) + ahead[-1], -30, 30)))
        g = np.append((x.T @ (p - y).astype(x.dtype)).astype(float) / n + l2 * ahead[:-1], (p - y).mean())
        v, w = w, ahead - rate * g
    return w


def _judge(batch: pa.RecordBatch):
    raw, offsets = buffers(batch.column("__text"))
    words = Words(raw, offsets)
    return raw, offsets, words, measures(words, raw, offsets)


class Scorer:
    def __init__(self, posterior: dict[int, float], rates: np.ndarray, weights: np.ndarray):
        self.posterior, self.rates, self.weights = posterior, rates, weights


def train(docs: DataFrame, text: str = "text", key: str = "doc_id", rows: int = TRAIN_ROWS) -> Scorer:
    """Fits label model on all documents' votes and the scorer on at most `rows` of them, those of the least hashes of id and text."""

    def cast(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, int] = {}
        for whole in batches:
            for batch in slices(whole, "__text", 1 << 20, 384):
                *_, m = _judge(batch)
                for p, c in zip(*np.unique(votes(m), return_counts=True), strict=True):
                    counts[int(p)] = counts.get(int(p), 0) + int(c)
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.int64()), pa.array(list(counts.values()), pa.int64())], ["pattern", "n"])

    source = docs.select(F.col(text).cast("binary").alias("__text"), F.struct(F.xxhash64(F.lit("quality"), F.col(key)).alias("id"), F.xxhash64(F.col(text)).alias("text")).alias("__pick"))
    found = arrow_map(source.select("__text"), cast, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n")).collect()
    posterior, rates = fit_labels({r["pattern"]: r["n"] for r in found})
    first = source.select("__pick").orderBy("__pick").limit(rows)
    last = first.agg(F.max("__pick").alias("m")).first()["m"]
    if last is None:
        return Scorer(posterior, rates, np.zeros(FEATURES + 1))
    edge = F.struct(F.lit(last["id"]).alias("id"), F.lit(last["text"]).alias("text"))
    room = first.where(F.col("__pick") == edge).count()

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "__text", 1 << 20, 384):
                raw, _, words, m = _judge(batch)
                x = shape_features(words, raw, batch.num_rows, m)
                at = [np.flatnonzero(r) for r in x]
                arrays = [pa.array(votes(m)), pa.array([a.astype(np.int16).tobytes() for a in at], pa.binary()), pa.array([r[a].tobytes() for r, a in zip(x, at, strict=True)], pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, ["pattern", "at", "value"])

    # the first rows by hash of id and text; rows that tie at the edge have one text, so any of them will do
    chosen = source.where(F.col("__pick") < edge).unionAll(source.where(F.col("__pick") == edge).limit(room))
    picked = arrow_map(chosen.select("__text"), sample, "pattern long, at binary, value binary").toArrow()
    x = np.zeros((picked.num_rows, FEATURES), dtype=np.float32)
    y = np.zeros(picked.num_rows)
    for i, (pattern, at, value) in enumerate(sorted(zip(*(picked.column(c).to_pylist() for c in picked.column_names), strict=True))):
        x[i, np.frombuffer(at, np.int16)] = np.frombuffer(value, np.float32)
        y[i] = posterior[pattern]
    return Scorer(posterior, rates, fit_linear(x, y))


MADE = T.StructType([T.StructField("quality_score", T.DoubleType()), T.StructField("keep", T.BooleanType()), T.StructField("label_posterior", T.DoubleType()), T.StructField("labellers", T.StringType())])


def classify(docs: DataFrame, scorer: Scorer, text: str = "text", keep: Sequence[str] = ("doc_id",), threshold: float = 0.5) -> DataFrame:
    """`keep` columns, quality_score (1: clean), keep, and the votes and posterior behind them."""
    made = {f.name for f in MADE.fields}
    fields = [docs.schema[c] for c in keep if c not in made]
    names = [f.name for f in fields]
    weights, posterior = scorer.weights, scorer.posterior

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "__text", 1 << 20, 384):
                raw, _, words, m = _judge(batch)
                x = shape_features(words, raw, batch.num_rows, m)
                junk = 1 / (1 + np.exp(-np.clip(x @ weights[:-1].astype(np.float32) + weights[-1], -30, 30)))
                score = np.round(np.where(m["words"] > 0, 1 - junk, 0.0).astype(np.float64), 6)
                v = votes(m).tolist()
                arrays = [
                    pa.array(score),
                    pa.array(score >= threshold),
                    pa.array([round(1 - posterior.get(p, 0.5), 6) for p in v], pa.float64()),
                    pa.array([",".join(name for i, name in enumerate(LABELLERS) if p >> i & 1) for p in v], pa.string()),
                ]
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(names))), *arrays], [*names, *(f.name for f in MADE.fields)])

    return arrow_map(docs.select(*(docs[c] for c in names), docs[text].cast("binary").alias("__text")), run, T.StructType([*fields, *MADE.fields]))
