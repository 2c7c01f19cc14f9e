"""Vectorised text primitives shared by the Arrow-batched operators.

Texts are handled as one byte buffer with row offsets, so that hashing,
tokenising and windowing are whole-array operations rather than row loops.
Every hash here is a fixed function of bytes: equal bytes give equal hashes
in every task, and no row's result depends on how rows are batched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Most bytes of text that one numpy pass works on; a longer single row is a pass of its own.
SLICE_BYTES = 2 << 20


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift and multiply)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def stream64(n: int, seed: int) -> np.ndarray:
    """n pseudo-random words, a counter run through the finaliser."""
    return mix64((np.arange(1, n + 1, dtype=U64) + U64(seed) * U64(1 << 32)) * U64(0x9E3779B97F4A7C15))


BYTE = stream64(256, 7)
BASE = U64(0xD6E8FEB86659FD93)
BASE_INV = U64(pow(int(BASE), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i below n."""
    if len(_powers.get("up", ())) < n:
        size = max(n, SLICE_BYTES + (1 << 16))
        for key, base in (("up", BASE), ("down", BASE_INV)):
            p = np.full(size, base, dtype=U64)
            p[0] = 1
            _powers[key] = np.cumprod(p, dtype=U64)
        if size > 4 * SLICE_BYTES:  # a very long row: do not keep its tables
            up, down = _powers.pop("up"), _powers.pop("down")
            return up, down
    return _powers["up"], _powers["down"]


def forget() -> None:
    """Drops the tables of powers."""
    _powers.clear()


class Rolling:
    """Polynomial hashes of any byte range of a buffer in constant time."""

    def __init__(self, buf: np.ndarray, table: np.ndarray = BYTE):
        up, self.down = powers(len(buf) + 1)
        self.prefix = np.zeros(len(buf) + 1, dtype=U64)
        np.cumsum(table[buf] * up[: len(buf)], out=self.prefix[1:])

    def ranges(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((self.prefix[end] - self.prefix[start]) * self.down[start])

    def grams(self, k: int) -> np.ndarray:
        n = len(self.prefix) - k
        return mix64((self.prefix[k:] - self.prefix[:n]) * self.down[:n]) if n > 0 else np.zeros(0, U64)


def as_binary(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.large_binary())


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a text column; a null row has no bytes."""
    column = as_binary(column)
    if column.null_count:
        column = pc.fill_null(column, b"")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    low = int(offsets[0]) if len(offsets) else 0
    high = int(offsets[-1]) if len(offsets) else 0
    return raw[low:high], offsets - low


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES, rows: int = 4096) -> Iterator[pa.RecordBatch]:
    """The batch in runs of whole rows of about `limit` bytes of text, `rows` rows at most."""
    if not batch.num_rows:
        return
    _, offsets = buffers(batch.column(column))
    start = 0
    while start < batch.num_rows:
        end = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
        end = min(max(end, start + 1), start + rows, batch.num_rows)
        yield batch.slice(start, end - start)
        start = end


def row_of(offsets: np.ndarray) -> np.ndarray:
    """For each byte, the row that holds it."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


class Words:
    """Words `[^\\x20\\x09-\\x0D]+` of A-Z-lower-cased texts: byte ranges, rows and 64-bit hashes."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray):
        self.buf = LOWER[buf]
        inside = ~SPACE[buf]
        edge = np.zeros(len(buf) + 1, dtype=bool)  # a row ends a word too
        edge[offsets] = True
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1] | edge[1:-1]
        last[:-1] &= ~inside[1:] | edge[1:-1]
        self.start = np.flatnonzero(first)
        self.end = np.flatnonzero(last) + 1
        self.row = np.searchsorted(offsets, self.start, side="right") - 1
        self.rolling = Rolling(self.buf)
        self.hash = self.rolling.ranges(self.start, self.end) ^ (self.end - self.start).astype(U64)
        self.count = np.bincount(self.row, minlength=len(offsets) - 1)
        self.first = np.concatenate(([0], np.cumsum(self.count)))  # word offsets of rows

    def shingles(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(hash, first word) of every run of n words within one row."""
        m = len(self.hash) - n + 1
        if m <= 0:
            return np.zeros(0, U64), np.zeros(0, np.int64)
        at = np.flatnonzero(self.row[:m] == self.row[n - 1 :])
        h = np.zeros(len(at), U64)
        for j in range(n):
            h = mix64(h * BASE + self.hash[at + j])
        return h, at


def whole_hash(words: Words, row: int) -> np.uint64:
    """One hash of all words of a row in order (rows shorter than a shingle)."""
    h = np.zeros(1, U64)
    for x in words.hash[words.first[row] : words.first[row + 1]]:
        h = mix64(h * BASE + x)
    return h[0]
