"""Exact removal of repeated byte strings with difference-cover suffix arrays.

Every `length`-byte string has one anchor: the k-byte string in it whose hash is
smallest (the first of equals).  Equal strings have equal anchors at equal places,
so only strings of one anchor can be equal, and an anchor seen once rules its
strings out.  Consecutive strings of one anchor make a context.  Contexts with a
recurring anchor are dealt out by it, the rows of very frequent anchors (found by a
sample of the rows, which decides nothing but where rows go) without it.  Of
contexts that agree in 128 bits of hash two stand for all; these are compared byte
by byte, and the different contexts of an anchor are suffix-sorted together.

Suffixes are sorted by the difference cover {1, 2} modulo 3: those at its places by
triples, which get names in order, then by recursion on the names; the rest by
their first symbol and the rank behind it; then both are merged.  Neighbours that
agree in `length` bytes are repeats.  Anchors are sorted whole in blocks of
contexts.  One whose contexts exceed a block is first parted by where strings have
the anchor, SPREAD places at a time, and by the bytes that all strings of such
places share, so equal strings stay together; a part that still exceeds a block is
sorted in the same way as DataFrames, by range partitions (`cover_ranks`), by its
strings' `length` bytes.

Defined results: a null text is the empty text; matches never cross rows; repeated
rows are repeats of each other, of equal strings (ties) all go; texts of any length
are searched whole, in pieces that overlap by length - 1 bytes; an empty table gives
an empty result; only `keep` columns are carried, and n_bytes, spans and kept win
over kept ones of the same name.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.frames import arrow_map, packed_checkpoint, release, small
from tessera.llm.textops import U64, Rolling, as_binary, buffers, mix64, powers, slices
from tessera.session import ensure_checkpoint_dir

LENGTH, ANCHOR = 200, 48
#: Bytes of contexts sorted at once, and most of one anchor.
BLOCK = 1 << 20
PLACE_BITS = 24
#: Places of the anchor in a string by which a very large anchor is parted.
SPREAD = 32
PIECE = 4 << 20
#: One row in PROBE is a probe; an anchor of PROBES contexts of probes or more is dealt out in SALTS parts.  The
#: list of such anchors is cut to the HEAVY most frequent, which bounds it; the rest stay whole.
PROBE, PROBES, SALTS, HEAVY = 64, 32, 64, 100_000
CONTEXT = ("anchor", "context", "check")


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Order of all suffixes of s (integers from 1), by the difference cover {1, 2} modulo 3."""
    n = len(s)
    if n < 4:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), dtype=np.int64)
    t = np.concatenate([s.astype(np.int64), np.zeros(4, np.int64)])
    places = np.arange(n + (n % 3 == 1))  # one more place, so that names of places 1 end in a smallest name
    one, two = places[places % 3 == 1], places[places % 3 == 2]
    sample = np.concatenate([one, two])
    width = np.int64(int(s.max()) + 1)
    triple = (t[sample] * width + t[sample + 1]) * width + t[sample + 2]
    order = np.argsort(triple)
    ranked = triple[order]
    name = np.empty(len(sample), dtype=np.int64)
    name[order] = np.concatenate(([0], np.cumsum(ranked[1:] != ranked[:-1]))) + 1
    if name.max() < len(name):
        order = suffix_array(name)
        name[order] = np.arange(1, len(name) + 1)
    rank = np.zeros(n + 4, dtype=np.int64)
    rank[sample] = name
    zero = np.arange(0, n, 3)
    big = np.int64(len(sample) + 1)
    zero_key = t[zero] * big + rank[zero + 1]
    by_zero = np.argsort(zero_key)
    zero, zero_key = zero[by_zero], zero_key[by_zero]
    # merge: each kind of sample suffix is compared with the others by what the cover makes comparable
    sorted_sample = np.empty(len(sample), dtype=np.int64)
    sorted_sample[name - 1] = sample
    sorted_sample = sorted_sample[sorted_sample < n]
    kind = sorted_sample % 3
    ones, twos = sorted_sample[kind == 1], sorted_sample[kind == 2]
    one_key = t[ones] * big + rank[ones + 1]
    pair = lambda i: (t[i] * width + t[i + 1]) * big + rank[i + 2]
    wide = int(width) * int(width) * int(big) < 1 << 62
    before = np.empty(len(sorted_sample), dtype=np.int64)  # place-0 suffixes before each sample suffix
    before[kind == 1] = np.searchsorted(zero_key, one_key)
    if wide:
        before[kind == 2] = np.searchsorted(pair(zero), pair(twos))
    else:  # names too large for one word: rank the pairs first
        heads = np.unique(np.concatenate([t[zero] * width + t[zero + 1], t[twos] * width + t[twos + 1]]))
        ranked_pair = lambda i: np.searchsorted(heads, t[i] * width + t[i + 1]) * big + rank[i + 2]
        before[kind == 2] = np.searchsorted(ranked_pair(zero), ranked_pair(twos))
    out = np.empty(n, dtype=np.int64)
    at = before + np.arange(len(sorted_sample))
    out[at] = sorted_sample
    free = np.ones(n, dtype=bool)
    free[at] = False
    out[free] = zero
    return out


def repeated_starts(parts: Sequence[bytes], length: int) -> list[np.ndarray]:
    """For each part, which of its starts begin a `length`-byte string that begins elsewhere in the parts too."""
    size = np.array([len(p) for p in parts])
    first = np.concatenate(([0], np.cumsum(size + 1)))
    text = np.frombuffer(b"".join(p + b"\0" for p in parts), dtype=np.uint8).astype(np.int64) + 1
    text[first[1:] - 1] = 0
    order = suffix_array(text + 1)
    room = np.repeat(first[1:] - 1, size + 1) - np.arange(len(text))  # bytes to the part's end
    order = order[room[order] >= length]
    h = Rolling((text - 1).astype(np.uint8)).ranges(order, order + length)
    twin = np.flatnonzero(h[1:] == h[:-1])
    view = np.lib.stride_tricks.sliding_window_view(text, length) if len(text) >= length else None
    same = np.zeros(len(text), dtype=bool)
    for at in range(0, len(twin), 20_000):  # equal prefixes, byte by byte
        pick = twin[at : at + 20_000]
        a, b = order[pick], order[pick + 1]
        good = (view[a] == view[b]).all(axis=1)
        same[a[good]] = True
        same[b[good]] = True
    return [same[first[i] : first[i] + max(0, size[i] - length + 1)] for i in range(len(parts))]


def anchors(raw: np.ndarray, offsets: np.ndarray, length: int, k: int) -> tuple[np.ndarray, ...]:
    """Contexts of rows of bytes: (row, start in the row, number of strings, anchor hash, two context hashes)."""
    empty = tuple(np.zeros(0, np.int64) for _ in range(6))
    if len(raw) < length:
        return empty
    rolling = Rolling(raw)
    grams = rolling.grams(k)
    place = U64((1 << PLACE_BITS) - 1)
    low = (grams & ~place) | np.arange(len(grams), dtype=U64)
    window, size = length - k + 1, 1
    while size * 2 <= window:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    if size < window:
        low = np.minimum(low[: len(low) - (window - size)], low[window - size :])
    row_end = np.repeat(offsets[1:], np.diff(offsets))
    starts = np.flatnonzero(row_end[: len(low)] - np.arange(len(low)) >= length)
    if not len(starts):
        return empty
    anchor = (low[starts] & place).astype(np.int64)
    new = np.ones(len(starts), dtype=bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1)
    at = np.flatnonzero(new)
    count = np.diff(np.append(at, len(starts)))
    start, anchor = starts[at], anchor[at]
    row = np.searchsorted(offsets, start, side="right") - 1
    context = mix64(rolling.ranges(start, start + count - 1 + length) + (count.astype(U64) << U64(20)) + (anchor - start).astype(U64))
    # the second hash is taken of the mixed k-byte hashes, so it does not collide where the first does
    up, down = powers(len(grams) + 1)
    sums = np.zeros(len(grams) + 1, dtype=U64)
    np.cumsum(mix64(grams + U64(1)) * up[: len(grams)], out=sums[1:])
    check = mix64((sums[start + count + length - k] - sums[start]) * down[start])
    return row, start - offsets[row], count, mix64(grams[anchor]).view(np.int64), context.view(np.int64), check.view(np.int64)


def _contexts(source: DataFrame, length: int, k: int, heavy: np.ndarray) -> DataFrame:
    """anchor, part, context, check, rid, start and count of every context; part is -1 but for the sorted `heavy` anchors."""
    names = ["anchor", "part", "context", "check", "rid", "start", "count"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "__text"):
                raw, offsets = buffers(batch.column("__text"))
                rid = batch.column("rid").to_numpy()
                if batch.num_rows > 1 or len(raw) <= PIECE:
                    pieces = [(raw, offsets, 0)]
                else:  # a very long row, in pieces that share no string
                    pieces = [(raw[a : a + PIECE + length - 1], None, a) for a in range(0, len(raw), PIECE)]
                for piece, cuts, shift in pieces:
                    row, start, count, anchor, context, check = anchors(piece, cuts if cuts is not None else np.array([0, len(piece)]), length, k)
                    if not len(row):
                        continue
                    part = np.full(len(row), -1, dtype=np.int8)
                    if len(heavy):
                        at = heavy[np.minimum(np.searchsorted(heavy, anchor), len(heavy) - 1)] == anchor
                        part[at] = mix64(rid[row[at]].view(U64)) % U64(SALTS)
                    made = (anchor, part, context, check, rid[row], start + shift, count.astype(np.int32))
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in made], names)

    return arrow_map(source, run, "anchor long, part byte, context long, check long, rid long, start long, count int")


def _recurring(every: DataFrame) -> DataFrame:
    """The contexts whose anchor stands in another context too: a stream sorted by anchor passes on rows that have a neighbour."""
    names = [c for c in every.columns if c != "part"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, given = None, False  # the last row so far, and whether it was passed on
        for batch in batches:
            if not batch.num_rows:
                continue
            if held is not None:
                batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            anchor, part = batch.column("anchor").to_numpy(), batch.column("part").to_numpy()
            twin = anchor[1:] == anchor[:-1]
            good = part >= 0
            good[1:] |= twin
            good[:-1] |= twin
            last = bool(good[-1])
            good[0] &= not given
            held, given = batch.slice(batch.num_rows - 1), last
            out = batch.filter(pa.array(good)).select(names)
            if out.num_rows:
                yield out

    # a frequent anchor's rows lie in several parts, so they need no neighbour
    dealt = every.repartition("anchor", "part").sortWithinPartitions("anchor", "part")
    return arrow_map(dealt, run, "anchor long, context long, check long, rid long, start long, count int")


def _packed(source: DataFrame) -> DataFrame:
    """The rows with the text compressed and its size, to be shuffled."""
    others = [f for f in source.schema.fields if f.name != "__text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd", compression_level=1)
        names = [f.name for f in others]
        for whole in batches:
            for batch in slices(whole, "__text"):
                texts = as_binary(batch.column("__text")).to_pylist()
                made = [pa.array([codec.compress(t, asbytes=True) for t in texts], pa.binary()), pa.array([len(t) for t in texts], pa.int64())]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *made], [*names, "__text", "__size"])

    return arrow_map(source, run, T.StructType([*others, T.StructField("__text", T.BinaryType()), T.StructField("__size", T.LongType())]))


def _unpacked(batch: pa.RecordBatch) -> list[bytes]:
    return [pa.decompress(b, n, codec="zstd", asbytes=True) if n else b"" for b, n in zip(as_binary(batch.column("__text")).to_pylist(), batch.column("__size").to_pylist(), strict=True)]


def _cut(texts: DataFrame, length: int) -> DataFrame:
    """The bytes of contexts: rows of a compressed text, its size and its list of wanted contexts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "__text", 1 << 19):
                out: list[tuple] = []
                for text, wanted in zip(_unpacked(batch), batch.column("wanted").to_pylist(), strict=True):
                    out += [(*(w[c] for c in CONTEXT), text[w["start"] : w["start"] + w["count"] - 1 + length]) for w in wanted]
                columns = list(zip(*out, strict=True)) or [[], [], [], []]
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.binary())], [*CONTEXT, "bytes"])

    return arrow_map(texts.select("__text", "__size", "wanted"), run, "anchor long, context long, check long, bytes binary")


RUNS = T.StructType([*(T.StructField(c, T.LongType()) for c in CONTEXT), T.StructField("from", T.IntegerType()), T.StructField("to", T.IntegerType())])


def _runs(same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last of each run of true values."""
    edge = np.diff(np.concatenate(([0], same.view(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1


def _sorted_blocks(cut: DataFrame, length: int, block: int) -> DataFrame:
    """Runs of repeated string starts in contexts, from suffix arrays of whole anchors' contexts.

    The two places of a context are compared byte by byte; where they agree, all its
    strings are repeats and one of the two is sorted with the anchor's others.
    """

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        kinds: dict[tuple, list[bytes]] = {}
        for *names, raw in rows:
            own = kinds.setdefault(tuple(names), [])
            own.append(raw)
        twins = {names for names, own in kinds.items() if len(own) > 1 and all(x == own[0] for x in own[1:])}
        entries = [(names, raw) for names, own in kinds.items() for raw in (own[:1] if names in twins else own)]
        of_anchor = Counter(names[0] for names, _ in entries)
        entries = [e for e in entries if of_anchor[e[0][0]] > 1]  # a lone context repeats no string of its own
        found = {names: np.ones(len(kinds[names][0]) - length + 1, dtype=bool) for names in twins}
        for (names, _), same in zip(entries, repeated_starts([raw for _, raw in entries], length) if entries else (), strict=True):
            found[names] = found[names] | same if names in found else same
        out: list[list[np.ndarray]] = [[] for _ in RUNS.names]
        for names, same in found.items():
            a, z = _runs(same)
            for column, x in zip(out, (*(np.full(len(a), v) for v in names), a, z), strict=True):
                column.append(x)
        merged = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in out]
        return pa.RecordBatch.from_arrays([pa.array(m, pa.int64() if i < 3 else pa.int32()) for i, m in enumerate(merged)], RUNS.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in (*CONTEXT, "bytes")), strict=True):
                if size >= block and row[0] != rows[-1][0]:
                    yield solve(rows)
                    rows, size = [], 0
                rows.append(row)
                size += len(row[-1])
        if rows:
            yield solve(rows)

    return arrow_map(cut.select(*CONTEXT, "bytes").repartition("anchor").sortWithinPartitions("anchor"), run, RUNS)


def _parted(cut: DataFrame, length: int, k: int) -> DataFrame:
    """Contexts of large anchors cut again by the place of the anchor in their strings, SPREAD places each.

    `anchor` is then a hash of the old one (`home`), the places and the bytes that all strings of these places
    share; `shift` is where the new context starts in the old one.
    """
    window = length - k + 1
    names = ["anchor", "home", *CONTEXT[1:], "shift", "bytes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "bytes", 1 << 19):
                raw, offsets = buffers(batch.column("bytes"))
                rolling = Rolling(raw)
                high = rolling.grams(k) >> U64(PLACE_BITS)
                rows, lows, ends, places, shared = [], [], [], [], []
                for i, (a, z) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
                    last = z - a - length  # the last string's start
                    at = int(np.argmin(high[a : a + window]))
                    for r in range((at - last) // SPREAD, at // SPREAD + 1):
                        low, top = r * SPREAD, min((r + 1) * SPREAD, window) - 1
                        rows.append(i)
                        lows.append(a + max(0, at - top))
                        ends.append(a + min(last, at - low) + length)
                        places.append(r)
                        shared.append((a + at - low, a + at - top + length))
                if not rows:
                    continue
                row, low = np.array(rows), np.array(lows)
                home = batch.column("anchor").to_numpy()[row]
                edges = np.array(shared)
                group = mix64(mix64(rolling.ranges(edges[:, 0], edges[:, 1]) + np.array(places, dtype=U64)) ^ home.view(U64)).view(np.int64)
                text = raw.tobytes()
                parts = [text[x:y] for x, y in zip(lows, ends, strict=True)]
                made = [pa.array(group), pa.array(home), *(batch.column(c).take(pa.array(row)) for c in CONTEXT[1:]), pa.array((low - offsets[row]).astype(np.int32)), pa.array(parts, pa.binary())]
                yield pa.RecordBatch.from_arrays(made, names)

    return arrow_map(cut.select(*CONTEXT, "bytes"), run, "anchor long, home long, context long, check long, shift int, bytes binary")


def _sorted_large(cut: DataFrame, length: int, k: int, block: int) -> DataFrame:
    """Runs of repeated string starts in contexts of anchors beyond a block."""
    parts = packed_checkpoint(_parted(cut, length, k))
    sizes = parts.groupBy("anchor").agg(F.sum(F.octet_length("bytes")).alias("bytes"))
    large = sizes.where(F.col("bytes") > block).select("anchor").checkpoint()
    runs = _sorted_blocks(parts.join(large, "anchor", "left_anti"), length, block)
    if not large.isEmpty():
        runs = runs.unionAll(_sorted_wide(parts.join(large, "anchor", "left_semi").select(*CONTEXT, "bytes"), length))
    back = runs.join(parts.select(*CONTEXT, "home", "shift").distinct(), [*CONTEXT])
    return back.select(F.col("home").alias("anchor"), *CONTEXT[1:], (F.col("from") + F.col("shift")).alias("from"), (F.col("to") + F.col("shift")).alias("to"))


def _symbols(texts: DataFrame, **places: int) -> DataFrame:
    """id, p and, by name, the symbols some places on from p (0 beyond the end) of texts (id, s)."""
    at = lambda i: F.coalesce(F.get("s", i), F.lit(0).cast("long"))
    each = F.transform("s", lambda x, i: F.struct(*(at(i + n).alias(name) for name, n in places.items())))
    return texts.select("id", F.posexplode(each).alias("p", "t")).select("id", "p", *(F.col(f"t.{name}") for name in places))


def _named(symbols: DataFrame, keys: Sequence[str]) -> DataFrame:
    """id, p and rank: a number for each different value of the keys, in their order."""
    kinds = symbols.select(*keys).distinct().repartitionByRange(*keys).sortWithinPartitions(*keys)
    kinds = kinds.withColumn("rank", F.monotonically_increasing_id() + 1).checkpoint()
    return symbols.join(kinds, [*keys]).select("id", "p", "rank")


def _merge(rows: DataFrame, rest: int) -> DataFrame:
    """id, p and rank of all suffixes, from rows with the ranks r0, r1, r2 of cover places at p, p + 1 and p + 2.

    u0 to u3 are the symbols behind those that the rank at p compares, of which the
    first `rest` count.  A range of first triples is merged in one task.
    """

    def dense(*keys: np.ndarray) -> np.ndarray:
        order = np.lexsort(keys[::-1])
        new = np.zeros(len(order), dtype=bool)
        for key in keys:
            new[1:] |= key[order][1:] != key[order][:-1]
        out = np.empty(len(order), dtype=np.int64)
        out[order] = np.cumsum(new)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held)
        ident, p, a, b, r0, r1, r2 = (t.column(c).to_numpy() for c in ("id", "p", "a", "b", "r0", "r1", "r2"))
        u = [t.column(f"u{i}").to_numpy() for i in range(rest)]
        kind = p % 3
        # what is comparable among places 1 and 2, of 0 with 0 and 1, and of 0 with 2
        by_cover, by_one, by_two = dense(r0, *u), dense(a, r1, *u[1:]), dense(a, b, r2, *u[2:])
        zero, cover = np.flatnonzero(kind == 0), np.flatnonzero(kind)
        zero, cover = zero[np.argsort(by_one[zero])], cover[np.argsort(by_cover[cover])]
        before = np.where(kind[cover] == 1, np.searchsorted(by_one[zero], by_one[cover]), np.searchsorted(by_two[zero], by_two[cover]))
        at = before + np.arange(len(cover))
        free = np.ones(len(p), dtype=bool)
        free[at] = False
        order = np.empty(len(p), dtype=np.int64)
        order[at], order[free] = cover, zero
        x, y = order[:-1], order[1:]
        two = (kind[x] == 2) | (kind[y] == 2)
        equal = np.where((kind[x] > 0) & (kind[y] > 0), by_cover[x] == by_cover[y], np.where(two, by_two[x] == by_two[y], by_one[x] == by_one[y]))
        rank = np.concatenate(([0], np.cumsum(~equal))) + (TaskContext.get().partitionId() << 33) + 1
        yield pa.RecordBatch.from_arrays([pa.array(ident[order]), pa.array(p[order]), pa.array(rank)], ["id", "p", "rank"])

    return arrow_map(rows.repartitionByRange("a", "b", "c"), run, "id long, p int, rank long")


def cover_ranks(texts: DataFrame, need: int) -> DataFrame:
    """id, p and rank, by its first `need` symbols, of every suffix of texts (id, s: symbols from 1)."""
    if need < 5:
        keys = {f"x{i}": i for i in range(need)}
        return _named(_symbols(texts, **keys), list(keys))
    names = _named(_symbols(texts, a=0, b=1, c=2).where("p % 3 <> 0"), ["a", "b", "c"])
    # one string of names for each residue; their suffixes are the cover's
    own = F.col("id") * 2 + F.col("p") % 3 - 1
    strings = names.groupBy(own.alias("id")).agg(F.array_sort(F.collect_list(F.struct("p", "rank"))).alias("s")).select("id", F.col("s.rank").alias("s"))
    triples = (need - 2) // 3  # no comparison by way of a cover place then goes beyond `need`
    inner = cover_ranks(strings.checkpoint(), triples)
    inner = inner.select(F.shiftright("id", 1).alias("id"), (F.col("p") * 3 + F.col("id") % 2 + 1).cast("int").alias("p"), "rank")
    w, zero = Window.partitionBy("id").orderBy("p"), F.lit(0).cast("long")
    ranks = {"r0": F.col("rank"), "r1": F.lead("rank", 1).over(w), "r2": F.lead("rank", 2).over(w)}
    rows = _symbols(texts, a=0, b=1, c=2, **{f"u{i}": 3 * triples + i for i in range(4)}).join(inner, ["id", "p"], "left")
    merged = _merge(rows.withColumns({k: F.coalesce(v, zero) for k, v in ranks.items()}), need - 3 * triples).checkpoint()
    del rows, inner, strings, names
    release(texts.sparkSession)
    return merged


def _sorted_wide(cut: DataFrame, length: int) -> DataFrame:
    """Runs of repeated string starts in contexts of any total size, from ranks of a distributed sort."""

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = [np.frombuffer(b, np.uint8).astype(np.int64) + 1 for b in batch.column("bytes").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(s, pa.list_(pa.int64()))], ["id", "s"])

    rows = cut.withColumn("id", F.monotonically_increasing_id()).checkpoint()
    ranks = cover_ranks(arrow_map(rows.select("id", "bytes"), spell, "id long, s array<long>").checkpoint(), length)
    ranks = ranks.join(rows.select("id", *CONTEXT, F.octet_length("bytes").alias("size")), "id").where(F.col("p") <= F.col("size") - length)
    # strings of one anchor only are compared, as in a block
    often = ranks.groupBy("anchor", "rank").agg(F.count("*").alias("n")).where("n > 1").select("anchor", "rank")
    return ranks.join(often, ["anchor", "rank"]).select(*CONTEXT, F.col("p").alias("from"), F.col("p").alias("to")).distinct()


def repeats(docs: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",), length: int = LENGTH, k: int = ANCHOR, block: int = BLOCK) -> DataFrame:
    """`keep` columns, n_bytes, `spans` of repeated bytes (start, end) and `kept`, the remaining bytes."""
    ensure_checkpoint_dir(docs.sparkSession)
    made = ("n_bytes", "spans", "kept")
    names = [c for c in keep if c not in made]
    raw = F.coalesce(F.col(text).cast("binary"), F.lit(b""))
    rows = docs.select(*(docs[c] for c in names), raw.alias("__text")).withColumn("rid", F.xxhash64(*names, "__text"))
    # rows whose names agree and whose second names do not (of N rows about N * N / 2**65) take the second
    second = F.xxhash64(F.lit(1), *names, "__text")
    twice = rows.select("rid", second.alias("o")).groupBy("rid").agg(F.min("o").alias("o0"), F.max("o").alias("o1")).where("o0 <> o1")
    twice = [r["rid"] for r in twice.select("rid").collect()]
    if twice:
        rows = rows.withColumn("rid", F.when(F.col("rid").isin(twice), second).otherwise(F.col("rid")))
    source = rows.where(F.octet_length("__text") >= length).select("rid", "__text")

    probes = _contexts(source.where(F.pmod("rid", F.lit(PROBE)) == 0), length, k, np.zeros(0, np.int64))
    heavy = probes.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") >= PROBES).orderBy(F.desc("n"), "anchor").limit(HEAVY).select("anchor").collect()
    seen = packed_checkpoint(_recurring(_contexts(source, length, k, np.sort(np.array([r["anchor"] for r in heavy], dtype=np.int64)))))
    release(docs.sparkSession)
    place = F.struct("rid", "start", "count")
    kinds = packed_checkpoint(seen.groupBy(*CONTEXT).agg(F.count("*").alias("n"), F.min(place).alias("one"), F.max(place).alias("two")))
    release(docs.sparkSession)
    # two places stand for a context that recurs, one for any other; those of an anchor are sorted together
    stands = kinds.select(*CONTEXT, F.explode(F.when(F.col("n") == 1, F.array("one")).otherwise(F.array("one", "two"))).alias("at"))
    stands = stands.select(*CONTEXT, "at.rid", "at.start", "at.count")
    sizes = kinds.groupBy("anchor").agg(F.sum(F.col("one.count") + (length - 1)).alias("bytes"))
    large = sizes.where(F.col("bytes") > block).select("anchor").checkpoint()

    def cut(contexts: DataFrame, of: DataFrame) -> DataFrame:
        wanted = contexts.groupBy("rid").agg(F.collect_list(F.struct(*CONTEXT, "start", "count")).alias("wanted"))
        return _cut(_packed(of).dropDuplicates(["rid"]).join(wanted, "rid"), length)

    runs = _sorted_blocks(cut(stands.join(large, "anchor", "left_anti"), source), length, block)
    if not large.isEmpty():
        wide = stands.join(large, "anchor", "left_semi")
        few = source.join(small(wide.select("rid").distinct(), 16), "rid", "left_semi")
        runs = runs.unionAll(_sorted_large(cut(wide, few), length, k, block))
        del wide, few
    # the files of contexts' bytes go before texts are shuffled again
    runs = runs.checkpoint()
    del kinds, stands, sizes, large
    release(docs.sparkSession)
    spans = seen.join(runs, [*CONTEXT]).select("rid", F.struct((F.col("start") + F.col("from")).alias("start"), (F.col("start") + F.col("to") + length).alias("end")).alias("span"))
    found = spans.groupBy("rid").agg(F.collect_set("span").alias("found"))
    joined = _packed(rows).join(found, "rid", "left").select(*names, "__text", "__size", "found")

    fields = [joined.schema[c] for c in names]
    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    schema = T.StructType([*fields, T.StructField("n_bytes", T.LongType()), T.StructField("spans", span), T.StructField("kept", T.BinaryType())])
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "__text"):
                spans, kept, sizes = [], [], []
                for text, found in zip(_unpacked(batch), batch.column("found").to_pylist(), strict=True):
                    merged: list[list[int]] = []
                    for s in sorted((f["start"], f["end"]) for f in found or ()):
                        if merged and s[0] <= merged[-1][1]:
                            merged[-1][1] = max(merged[-1][1], s[1])
                        else:
                            merged.append(list(s))
                    edges = [0, *(x for m in merged for x in m), len(text)]
                    kept.append(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
                    spans.append([{"start": a, "end": b} for a, b in merged])
                    sizes.append(len(text))
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(names))), pa.array(sizes, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary())], [*names, *made])

    return arrow_map(joined, finish, schema)
