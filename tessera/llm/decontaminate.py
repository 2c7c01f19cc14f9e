"""Benchmark decontamination by SimHash windows.

A benchmark item has a weighted set of word shingles (weight: occurrences) and a
64-bit SimHash of it.  Documents are cut into windows of the item's own number of
words; a window's SimHash is found from running sums of its shingles' bits.  A
window that reaches the similarity differs from the item in a bounded total
weight, and a bit sum changes by that weight at most: the bits whose sum in the
item is greater, whatever the shingles and their weights, are the same in both.
Windows that agree with the item in these firm bits are verified by exact weighted
Jaccard similarity, so the fingerprints exclude no match.  Long items have few
firm bits; all their windows are verified then.

Windows without any shingle of the benchmark have similarity 0 and are not formed.

The benchmark is a stated query set: it goes to the tasks in blocks of at most
`BLOCK_BYTES` of text, each block against all documents.

Defined results: null texts, and texts or items without words, match nothing; a
text or item shorter than a shingle is one shingle, its whole sequence (such an
item matches whole equal texts only, not a place in a longer one); a text
shorter than an item is one window; repeated documents or items match each on
its own; of equally similar windows the first is reported.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.frames import arrow_map
from tessera.llm.textops import U64, Words, buffers, slices, whole_hash

SHINGLE, SIMILARITY, BITS = 5, 0.8, 64
BLOCK_BYTES = 16 << 20
FILTER_BITS = 22
#: Windows whose bit sums are formed at once.
CHUNK = 4096


def signs(hashes: np.ndarray) -> np.ndarray:
    """Rows of +1 and -1, the bits of each hash."""
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).astype(np.int32) * 2 - 1


def fingerprint(sums: np.ndarray) -> np.ndarray:
    """SimHash bits of rows of bit sums (a sum of 0 counts as 0)."""
    return sums > 0


def packed(bits: np.ndarray) -> np.ndarray:
    """Rows of 64 bits as one word each."""
    return np.packbits(bits, axis=1).view(U64).reshape(-1)


class Benchmark:
    """Items with their number of words, shingle weights, bit sums and fingerprints."""

    def __init__(self, items: Sequence[tuple[object, str]], n: int = SHINGLE):
        self.n = n
        self.ids, self.words, self.sets, self.total, sums = [], [], [], [], []
        for key, text in items:
            raw = np.frombuffer((text or "").encode(), dtype=np.uint8)
            words = Words(raw, np.array([0, len(raw)]))
            if not len(words.hash):
                continue
            h = words.shingles(n)[0] if len(words.hash) >= n else np.array([whole_hash(words, 0)], dtype=U64)
            shingle, weight = np.unique(h, return_counts=True)
            self.ids.append(key)
            self.words.append(len(words.hash))
            self.sets.append((shingle, weight))
            self.total.append(int(weight.sum()))
            sums.append((signs(shingle) * weight[:, None]).sum(axis=0))
        self.sums = np.array(sums, dtype=np.int64).reshape(len(self.ids), BITS)
        self.bits = packed(fingerprint(self.sums))
        self.all = np.unique(np.concatenate([s for s, _ in self.sets])) if self.sets else np.zeros(0, U64)
        self.owners: dict[int, list[int]] = {}
        for i, (shingle, _) in enumerate(self.sets):
            for h in shingle.tolist():
                self.owners.setdefault(h, []).append(i)
        self.filter = np.zeros(1 << FILTER_BITS, dtype=bool)
        self.filter[(self.all >> U64(64 - FILTER_BITS)).astype(np.int64)] = True

    def hits(self, hashes: np.ndarray) -> np.ndarray:
        """Indices of hashes that are shingles of the benchmark."""
        at = np.flatnonzero(self.filter[(hashes >> U64(64 - FILTER_BITS)).astype(np.int64)])
        return at[np.isin(hashes[at], self.all)] if len(at) else at

    def firm(self, i: int, width: int, similarity: float) -> np.uint64:
        """The fingerprint bits that every window of `width` shingles and the wanted similarity has in common with the item."""
        total = self.total[i] + width
        shared = int(np.ceil(similarity * total / (1 + similarity) - 1e-9))  # the least that reaches the similarity
        return packed(np.abs(self.sums[i : i + 1]) > total - 2 * shared)[0]

    def shared(self, i: int, hashes: np.ndarray, places: np.ndarray, width: int, starts: np.ndarray) -> np.ndarray:
        """Shingles that item and window share, with their multiplicity, for the windows at `starts`; `places` are the item's shingles in the text.

        An occurrence counts in the windows that hold it, but fewer than its shingle's weight of earlier ones."""
        shingle, weight = self.sets[i]
        at = np.searchsorted(shingle, hashes[places])
        order = np.argsort(at, kind="stable")
        at, place = at[order], places[order]
        before = np.arange(len(at)) - weight[at]  # the occurrence that must lie before the window
        known = (before >= 0) & (at[before] == at)
        begin = np.maximum(np.where(known, place[before], -1), place - width) + 1
        low = int(starts[0])
        steps = np.zeros(int(starts[-1]) - low + 2, dtype=np.int64)
        np.add.at(steps, np.clip(begin - low, 0, len(steps) - 1), 1)
        np.add.at(steps, np.clip(place + 1 - low, 0, len(steps) - 1), -1)
        return np.cumsum(steps)[starts - low]

    def match(self, hashes: np.ndarray, total_words: int, similarity: float) -> list[tuple[int, float, int, int]]:
        """(item, similarity, first word, words) of the best window of each matching item in one text's shingle hashes."""
        places: dict[int, list[int]] = {}
        for p in self.hits(hashes).tolist():
            for i in self.owners[int(hashes[p])]:
                places.setdefault(i, []).append(p)
        lengths: dict[int, list[int]] = {}
        for i in places:
            lengths.setdefault(min(self.words[i], total_words), []).append(i)
        best: dict[int, tuple[float, int, int]] = {}
        for length, items in lengths.items():
            width = max(length - self.n + 1, 1)  # shingles of a window
            last = len(hashes) - width
            edge = np.zeros(last + 2, dtype=np.int64)  # windows with a shingle of one of the items
            where = np.unique(np.concatenate([places[i] for i in items]))
            np.add.at(edge, np.clip(where - width + 1, 0, last + 1), 1)
            np.add.at(edge, np.minimum(where, last) + 1, -1)
            first = np.flatnonzero(np.cumsum(edge)[: last + 1])
            windows = np.empty(len(first), dtype=U64)
            cuts = [0, *(np.flatnonzero(np.diff(first) > width) + 1).tolist(), len(first)]  # runs of windows that meet
            for a, z in zip(cuts[:-1], cuts[1:], strict=True):
                for at in range(a, z, CHUNK):
                    some = first[at : min(at + CHUNK, z)]
                    low, high = int(some[0]), int(some[-1]) + width
                    sums = np.zeros((high - low + 1, BITS), dtype=np.int32)
                    np.cumsum(signs(hashes[low:high]), axis=0, out=sums[1:])
                    windows[at : at + len(some)] = packed(fingerprint(sums[some - low + width] - sums[some - low]))
            for i in items:
                starts = first[(windows ^ self.bits[i]) & self.firm(i, width, similarity) == 0]
                if not len(starts):
                    continue
                both = self.shared(i, hashes, np.array(places[i]), width, starts)
                ratio = both / (width + self.total[i] - both)
                top = int(np.argmax(ratio))
                if ratio[top] >= similarity:
                    best[i] = (float(ratio[top]), int(starts[top]), length)
        return [(i, *b) for i, b in sorted(best.items())]

    def rows(self, column: pa.Array, similarity: float) -> list[tuple[int, int, float, int, int]]:
        """(row, item, similarity, first word, words) of all matches of a text column."""
        raw, offsets = buffers(column)
        words = Words(raw, offsets)
        h, at = words.shingles(self.n)
        row = words.row[at]
        some = set(row[self.hits(h)].tolist())
        some.update(np.flatnonzero((words.count > 0) & (words.count < self.n)).tolist())
        found = []
        for r in sorted(some):
            count = int(words.count[r])
            own = h[np.searchsorted(row, r) : np.searchsorted(row, r + 1)] if count >= self.n else np.array([whole_hash(words, r)], dtype=U64)
            found += [(r, *m) for m in self.match(own, count, similarity)]
        return found


def _blocks(benchmark: DataFrame, key: str, text: str, limit: int) -> Iterator[list[tuple[object, str]]]:
    """The items in blocks of about `limit` bytes."""
    rows = benchmark.where(F.col(text).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("t"))
    size = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = -(-size // limit)
    for b in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("k", "t"), F.lit(n)) == b)
        yield [(r["k"], r["t"]) for r in sorted(part.collect(), key=lambda r: (r["k"] is None, r["k"], r["t"]))]


def matches(docs: DataFrame, benchmark: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",), item: str = "item_id", item_text: str = "text", n: int = SHINGLE, similarity: float = SIMILARITY, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """A row for each document and item that match: `keep`, item_id, similarity, first_word, n_words."""
    made = T.StructType([T.StructField("item_id", benchmark.schema[item].dataType), T.StructField("similarity", T.DoubleType()), T.StructField("first_word", T.LongType()), T.StructField("n_words", T.LongType())])
    fields = [docs.schema[c] for c in keep if c not in {f.name for f in made.fields}]
    names = [f.name for f in fields]
    schema = T.StructType([*fields, *made.fields])
    source = docs.select(*(docs[c] for c in names), docs[text].cast("binary").alias("__text"))

    def against(items: list[tuple[object, str]]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bench = Benchmark(items, n)
            for whole in batches:
                for batch in slices(whole, "__text"):
                    found = bench.rows(batch.column("__text"), similarity)
                    if found:
                        taken = batch.take(pa.array([f[0] for f in found], pa.int64()))
                        ids = pa.array([bench.ids[f[1]] for f in found])
                        arrays = [ids, pa.array([round(f[2], 6) for f in found], pa.float64()), pa.array([f[3] for f in found], pa.int64()), pa.array([f[4] for f in found], pa.int64())]
                        yield pa.RecordBatch.from_arrays([*(taken.column(i) for i in range(len(names))), *arrays], [*names, *(f.name for f in made.fields)])

        return arrow_map(source, run, schema)

    parts = [against(items) for items in _blocks(benchmark, item, item_text, block_bytes)]
    return reduce(DataFrame.unionAll, parts) if parts else source.sparkSession.createDataFrame([], schema)


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", n: int = SHINGLE, similarity: float = SIMILARITY, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents that match no item, all columns kept, in one pass for each block of items."""

    def without(rows: DataFrame, items: list[tuple[object, str]]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bench = Benchmark(items, n)
            for whole in batches:
                for batch in slices(whole, text):
                    hit = {r for r, *_ in bench.rows(batch.column(text), similarity)}
                    yield batch.take(pa.array([i for i in range(batch.num_rows) if i not in hit], pa.int64()))

        return arrow_map(rows, run, rows.schema)

    return reduce(without, _blocks(benchmark, item, item_text, block_bytes), docs)
